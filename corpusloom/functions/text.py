"""Text columns: note views, tags, slugs, tokens."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ROOTS = ("projects", "areas", "resources", "archive")

# Patterns (Java's dialect).  Groups that repeat without bound are
# possessive: the engine loops over those and recurses on others, once a line.
FRONTMATTER = r"\A---(?:\r\n|\n|\r)(?:(?!---(?:[\r\n]|\z))[^\r\n]*+(?:\r\n|\n|\r))*+---(?:\r\n|\n|\r|\z)"
WIKILINK = r"!?\[\[(?:[^\[\]|]+?\|\s*([^\[\]]+?)\s*|\s*([^\[\]|]+?)\s*)\]\]"
LEAD_IN = r"^(?:what-is|what-are|whats|what-does|define|definition-of|meaning-of)-"
TRAILER = r"-(?:mean|means|defined)$"

#: The index folds letters to their base: those that decompose into one character and
#: marks; others (sharp s, ligatures, barred letters) stay.
FOLDS = {
    c: base[0]
    for c in map(chr, range(0x80, 0x10000))
    if unicodedata.decomposition(c)[:1] not in ("", "<")
    and len(base := "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))) == 1
    and base != c
}
FOLDED, FOLDED_TO = "".join(FOLDS), "".join(FOLDS.values())
#: What the characters of Latin-1 are in the index: folded, or a space if they belong to no word.
LATIN = "".join(f if unicodedata.category(f := FOLDS.get(c, c).lower())[0] in "LN" else " " for c in map(chr, range(256))).encode("latin-1")


def strip_frontmatter(text: Column) -> Column:
    """Without a leading block between ``---`` lines; an open block stays."""
    return F.when(text.startswith("---"), F.regexp_replace(text, FRONTMATTER, "")).otherwise(text)


def frontmatter_inner(text: Column) -> Column:
    """The lines between the fences; null without a closed block."""
    head = F.regexp_extract(text, FRONTMATTER, 0)
    inner = F.regexp_replace(F.regexp_replace(head, r"\A---(?:\r\n|\n|\r)", ""), r"---(?:\r\n|\n|\r|\z)\z", "")
    return F.when(head != "", inner)


def frontmatter_parts(text: Column) -> Column:
    """(open, inner, close, body), which make up the text again: the opening
    line, the lines between the fences, the closing line and what follows; all
    but the body are null without a closed block."""
    head = F.regexp_extract(text, FRONTMATTER, 0)
    found = head != ""
    open_, close = F.regexp_extract(head, r"\A---(?:\r\n|\n|\r)", 0), F.regexp_extract(head, r"---(?:\r\n|\n|\r)?\z", 0)
    inner = F.substring(head, F.length(open_) + 1, F.length(head) - F.length(open_) - F.length(close))
    body = F.substring(text, F.length(head) + 1, F.length(text))
    return F.struct(F.when(found, open_).alias("open"), F.when(found, inner).alias("inner"), F.when(found, close).alias("close"), body.alias("body"))


def split_frontmatter_strict(text: Column) -> Column:
    """(head, body) by the literal fences only; head is null without them."""
    end = F.locate("\n---\n", text, 4)
    found = text.startswith("---\n") & (end > 0)
    head = F.when(found, F.substring(text, F.lit(1), end + 4))
    body = F.when(found, F.substring(text, end + 5, F.length(text))).otherwise(text)
    return F.struct(head.alias("head"), body.alias("body"))


def strip_wikilinks(text: Column) -> Column:
    return F.regexp_replace(text, WIKILINK, "$1$2")


def canonical_body(text: Column) -> Column:
    """What a note says: no frontmatter, no link markup, one final newline."""
    plain = F.replace(F.replace(strip_frontmatter(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    body = F.btrim(strip_wikilinks(plain), F.lit("\n"))
    return F.when(body == "", "").otherwise(F.concat(body, F.lit("\n")))


def raw_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def content_hash(text: Column) -> Column:
    return raw_hash(canonical_body(text))


def unquote(s: Column) -> Column:
    return F.regexp_replace(F.trim(s), "^['\"]+|['\"]+$", "")


def parse_tags(text: Column) -> Column:
    """The ``tags:`` of the frontmatter: inline list, block list or scalar; the
    first key counts; empty if absent."""
    inner = F.coalesce(frontmatter_inner(text), F.lit(""))
    line = r"(?m)^[ \t]*tags:[ \t]*"
    rest = F.trim(F.regexp_extract(inner, line + r"([^\r\n]*)$", 1))
    inline = F.filter(F.split(F.regexp_extract(rest, r"^\[(.*)\]$", 1), ","), lambda t: F.trim(t) != "")
    block = F.regexp_extract(inner, line + r"\r?\n((?:[ \t]*- [^\r\n]*(?:\r?\n|\z)|[ \t]*\r?\n)*+)", 1)
    items = F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*- ([^\r\n]*)$"), F.lit(1))
    empty = F.array().cast("array<string>")
    return (
        F.when(~inner.rlike(line), empty)
        .when(rest.startswith("[") & rest.endswith("]"), F.transform(inline, unquote))
        .when(rest != "", F.array(unquote(rest)))
        .otherwise(F.transform(items, unquote))
    )


def parse_aliases(text: Column) -> Column:
    """The ``aliases:`` of the strictly fenced head: inline or block list."""
    head = F.coalesce(split_frontmatter_strict(text)["head"], F.lit(""))
    inner = F.regexp_replace(F.regexp_replace(head, r"\A---\n", ""), r"\n---\n?\z", "\n")
    inline = F.regexp_extract(inner, r"(?m)^aliases:\s*\[(.*?)\]\s*$", 1)
    has_inline = inner.rlike(r"(?m)^aliases:\s*\[(.*?)\]\s*$")
    block = F.regexp_extract(inner, r"(?m)^aliases:\s*\n((?:[ \t]*-[ \t]*.+\n?)++)", 1)
    items = F.transform(F.filter(F.split(block, "\n"), lambda s: F.trim(s) != ""), lambda s: F.regexp_replace(s, r"^[ \t]*-[ \t]*", ""))
    chosen = F.when(has_inline, F.filter(F.split(inline, ","), lambda t: F.trim(t) != "")).otherwise(items)
    return F.transform(chosen, unquote)


def display_title(text: Column, slug: Column) -> Column:
    """The first ``# `` line, else the slug with spaces."""
    title = F.trim(F.regexp_extract(text, r"(?m)^# (.*)$", 1))
    return F.when(text.rlike(r"(?m)^# "), title).otherwise(F.translate(slug, "-", " "))


def slugify_title(title: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, joined by ``-``."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalise_key(term: Column) -> Column:
    """A term's lookup key and file name: punctuation goes, white space and
    ``_`` become ``-``; letters of any script stay."""
    s = F.regexp_replace(F.lower(F.trim(term)), r"(?U)[^\w\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[\s_]+", "-"), "-+", "-")
    return F.regexp_replace(s, "^-+|-+$", "")


def strip_lead_in(key: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(key, LEAD_IN, ""), TRAILER, "")


def normalise_tag(tag: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(tag)), r"(?U)[-_\s]+", "-"), "^-+|-+$", "")


def snippet(text: Column, size: int = 240) -> Column:
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.rtrim(F.substring(flat, 1, size)), F.lit("…"))).otherwise(flat)


def query_terms(query: Column) -> Column:
    """Lower-case words of a query, repeats included."""
    return F.regexp_extract_all(F.lower(query), F.lit(r"(?U)(\w+)"), F.lit(1))


def match_expression(query: Column) -> Column:
    """The words quoted and OR-joined, as a full-text engine takes them."""
    return F.array_join(F.transform(query_terms(query), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def index_tokens(text: Column) -> Column:
    """Tokens of the full-text index: runs of letters, digits and private-use
    characters, folded to lower case without diacritics; marks that stand by
    themselves behind a letter go."""
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


def folded(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.lower(F.when(plain, text).otherwise(F.regexp_replace(F.translate(text, FOLDED, FOLDED_TO), r"\p{M}+", "")))


def index_words(text: Column) -> Column:
    """:func:`index_tokens` as one string, joined by spaces.  Texts in Latin-1
    take a table of its 256 characters, others the pattern."""
    latin = F.arrow_udf(latin_words, "string")(F.coalesce(text, F.lit("")))
    return F.coalesce(latin, F.trim(F.regexp_replace(folded(text), r"[^\p{L}\p{N}\p{Co}]++", " ")))


def latin_words(texts: pa.Array) -> pa.Array:
    """The words of texts in Latin-1, joined by spaces; null for others."""

    def words(text: str) -> str | None:
        try:
            return b" ".join(text.encode("latin-1").translate(LATIN).split()).decode("latin-1")
        except UnicodeEncodeError:
            return None

    return pa.array([words(t) for t in texts.to_pylist()], pa.string())


def nonempty_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\r\n|\n|\r"), lambda s: F.regexp_replace(s, r"(?U)\s+", "") != ""))


def stem(path: Column) -> Column:
    """A path's file name without its last extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def linked_form(slug: Column, matched: Column) -> Column:
    return F.when(slug == matched, F.concat(F.lit("[["), slug, F.lit("]]"))).otherwise(F.concat(F.lit("[["), slug, F.lit("|"), matched, F.lit("]]")))


def is_note_path(path: Column) -> Column:
    """Whether a path is ``vault/<root>/….md``."""
    parts = F.split(path, "/")
    return (F.size(parts) >= 3) & (parts[0] == "vault") & parts[1].isin(*ROOTS) & path.endswith(".md")


def sidecar_path(path: Column, keep_suffix: bool = False) -> Column:
    """``a/b.md`` to ``a/.b.embed.json``; with ``keep_suffix`` ``a/.b.md.embed.json``."""
    folder, name = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    return F.concat(folder, F.lit("."), name if keep_suffix else F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(".embed.json"))


def source_of_sidecar(path: Column, suffix: str = ".md") -> Column:
    folder, name = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    return F.concat(folder, F.regexp_extract(name, r"^\.(.*)\.embed\.json$", 1), F.lit(suffix))


def relative_to(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)


def tags_line(tags: Column) -> Column:
    return F.concat(F.lit("tags: ["), F.array_join(tags, ", "), F.lit("]"))


def related_lines(names: Column) -> Column:
    items = F.transform(names, lambda n: F.concat(F.lit('  - "[['), n, F.lit(']]"')))
    return F.array_join(F.concat(F.array(F.lit("related_auto:")), items), "\n")


def block_state(text: Column, begin: str, end: str) -> Column:
    """present, absent, or broken where only one marker is there."""
    a, b = text.contains(begin), text.contains(end)
    return F.when(a & b, "present").when(a | b, "broken").otherwise("absent")


def splice_block(text: Column, begin: str, end: str, body: Column) -> Column:
    """``text`` with the managed block's body set; null where a marker is alone."""
    block = F.concat(F.lit(begin + "\n"), body, F.lit("\n" + end))
    before = F.substring_index(text, begin, 1)
    rest = F.substring(text, F.length(before) + len(begin) + 1, F.length(text))
    after = F.substring(rest, F.locate(end, rest) + len(end), F.length(rest))
    after = F.when(F.locate(end, rest) > 0, after).otherwise("")
    lead = F.when(text == "", "").when(text.endswith("\n"), F.concat(text, F.lit("\n"))).otherwise(F.concat(text, F.lit("\n\n")))
    state = block_state(text, begin, end)
    return F.when(state == "present", F.concat(before, block, after)).when(state == "absent", F.concat(lead, block, F.lit("\n")))


def remove_block(text: Column, begin: str, end: str) -> Column:
    before = F.substring_index(text, begin, 1)
    rest = F.substring(text, F.length(before) + len(begin) + 1, F.length(text))
    after = F.when(F.locate(end, rest) > 0, F.substring(rest, F.locate(end, rest) + len(end), F.length(rest))).otherwise("")
    before, after = F.regexp_replace(before, r"\n+\z", ""), F.regexp_replace(after, r"\A\n+", "")
    both = F.concat(before, F.when((before != "") & (after != ""), "\n\n").otherwise(""), after)
    both = F.when((both != "") & ~both.endswith("\n"), F.concat(both, F.lit("\n"))).otherwise(both)
    state = block_state(text, begin, end)
    return F.when(state == "present", both).when(state == "absent", text)


def term_note(term: Column, definition: Column | None = None, aliases: Column | None = None) -> Column:
    """The text of a new term's note, with a place for its definition or with one."""
    # The head and the line for a definition.
    head, said = "---\ntype: glossary\naliases: [", "A one-line definition — state the meaning atomically, one term, one idea."
    names = F.lit("") if aliases is None else F.array_join(aliases, ", ")
    meaning = F.lit(said) if definition is None else F.coalesce(F.trim(definition), F.lit(said))
    return F.concat(F.lit(head), names, F.lit("]\ntags: [glossary]\n---\n\n# "), term, F.lit("\n\n"), term, F.lit(" ? "), meaning, F.lit("\n\n#flashcards/glossary\n"))


def hit_line(score: Column, path: Column) -> Column:
    return F.format_string("%.4f  %s", score, path)
