"""Text columns: cleaning, document text, semantic type, headings, names, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import model

# The characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def strip(text: Column) -> Column:
    """Remove white space of any script from both ends."""
    return F.trim(text, F.lit(WHITE_SPACE))


def clean_text(text: Column) -> Column:
    """Null to empty, one kind of line break, single blanks, at most three line breaks, stripped."""
    unified = F.coalesce(text.cast("string"), F.lit(""))
    for old, new in (("\r\n", "\n"), ("\r", "\n"), ("\u3000", " ")):
        unified = F.replace(unified, F.lit(old), F.lit(new))
    blanks = F.regexp_replace(unified, r"[ \t]+", " ")
    return strip(F.regexp_replace(blanks, r"\n{4,}", "\n\n\n"))


def normalize_list(value: Column, is_array: bool = True) -> Column:
    """Null becomes an empty list, a scalar a list of one; nulls inside are dropped."""
    items = value if is_array else F.array(value)
    texts = F.transform(items, lambda item: item.cast("string"))
    return F.coalesce(F.filter(texts, lambda item: item.isNotNull()), F.array().cast("array<string>"))


def document_text(title: Column, source_type: Column, content: Column, cleaned: bool = False) -> Column:
    """The text that is chunked: a two-line header, a blank line, the content."""
    if not cleaned:
        title, source_type, content = clean_text(title), clean_text(source_type), clean_text(content)
    return strip(F.concat(F.lit("Title: "), title, F.lit("\nSource type: "), source_type, F.lit("\n\n"), content))


def mentions(text: Column, words: str | None, free_text: str | None = None, labels: str | None = None) -> Column:
    """True where the text holds one of the words, of the labels before a colon, or of the free texts."""
    parts = []
    if words:
        parts.append(rf"\b({words})\b")
    if free_text:
        parts.append(free_text)
    if labels:
        parts.append(rf"\b({labels}):(\s|\z)")
    return text.rlike("(?iU)" + "|".join(parts))


def semantic_type(source_type: Column, title: Column, content: Column, cleaned: bool = False) -> Column:
    """Coarse type of a document: by source where that decides, else by the words it holds.

    Matching whole words in any script is slow, so a pattern runs only on texts that hold one of its words
    as a plain substring.
    """
    if not cleaned:
        source_type, title, content = clean_text(source_type), clean_text(title), clean_text(content)
    source = F.lower(source_type)
    by_source = F.lit(None).cast("string")
    for name, kind in model.SOURCE_TO_SEMANTIC_TYPE.items():
        by_source = F.when(source == name, kind).otherwise(by_source)

    def judge(text: Column, lowered: Column) -> Column:
        def holds(words: str, free_text: str | None = None, labels: str | None = None) -> Column:
            plain = words.split("|") + (free_text.split("|") if free_text else []) + (
                [f"{label}:" for label in labels.split("|")] if labels else [])
            return contains_any(lowered, plain, is_lower=True) & mentions(text, words, free_text, labels)

        by_words = F.lit("generic_doc")
        for kind, words, free_text in reversed(model.DOCUMENT_TYPE_WORDS):
            found = holds(words, free_text, model.DOCUMENT_TYPE_LABELS.get(kind))
            by_words = F.when(found, kind).otherwise(by_words)
        is_issue = ~holds(model.CODE_CHANGE_WORDS) & holds(model.ISSUE_WORDS)
        on_github = F.when(is_issue, "issue_ticket").otherwise("code_change")
        return F.when(source == "github", on_github).otherwise(by_words)

    body = F.concat(title, F.lit("\n"), content)
    # the two letters that lower-case to themselves but match s and i when case is ignored
    lowered = F.regexp_replace(F.regexp_replace(F.lower(body), "ſ", "s"), "ı", "i")
    # an array of one, so that both forms of the text are computed once for all patterns
    forms = F.array(F.struct(body.alias("text"), lowered.alias("lowered")))
    return F.coalesce(by_source, F.get(F.transform(forms, lambda f: judge(f["text"], f["lowered"])), F.lit(0)))


def lines(text: Column) -> Column:
    return F.split(text, _LINE_BREAK)


def section_heading(text: Column) -> Column:
    """The first line that looks like a heading, cut to its maximum length; else empty."""
    headings = F.filter(F.transform(lines(text), strip), lambda line: line.rlike(model.SECTION_LINE))
    return F.coalesce(F.substring(F.get(headings, F.lit(0)), 1, model.SECTION_MAX_CHARS), F.lit(""))


def normalize_name(name: Column) -> Column:
    """Lower case, punctuation to blanks, single blanks."""
    words = F.regexp_replace(F.lower(name), r"(?U)[^\w\s]+", " ")
    return strip(F.regexp_replace(words, r"(?U)[\s\x1c-\x1f]+", " "))


def entity_id(name: Column) -> Column:
    """A slug of the name; names without Latin letters or digits get a digest instead."""
    slug = F.regexp_replace(F.regexp_replace(normalize_name(name), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    digest = F.concat(F.lit("entity_"), F.substring(F.sha1(name.cast("binary")), 1, 12))
    return F.when(slug != "", slug).otherwise(digest)


def text_summary(text: Column, max_chars: int = 200) -> Column:
    """Single blanks; a long text keeps its start, its length and a digest."""
    flat = strip(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))
    cut = F.concat(
        F.substring(flat, 1, max_chars), F.lit("...<len="), F.length(flat).cast("string"),
        F.lit(" sha256="), F.substring(F.sha2(flat, 256), 1, 12), F.lit(">"),
    )
    return F.when(F.length(flat) <= max_chars, flat).otherwise(cut)


def hash_text(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def preview(text: Column, max_chars: int = 240) -> Column:
    return F.translate(F.substring(text, 1, max_chars), "\n", " ")


def profile_slug(name: Column, parent_size: Column, parent_overlap: Column,
                 child_size: Column, child_overlap: Column) -> Column:
    """A path-safe profile name followed by its sizes; a name without safe characters is an error."""
    safe = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "_"), r"^[._-]+|[._-]+$", "")
    slug = F.format_string("%s_p%s-o%s_c%s-o%s", safe, parent_size.cast("string"), parent_overlap.cast("string"),
                           child_size.cast("string"), child_overlap.cast("string"))
    message = F.concat(F.lit("no safe character in profile name: "), name)
    return F.when(safe != "", slug).otherwise(F.raise_error(message).cast("string"))


def contains_any(text: Column, phrases: list[str], is_lower: bool = False) -> Column:
    """True where the lower-cased text holds any of the phrases."""
    lowered = text if is_lower else F.lower(text)
    found = F.lit(False)
    for phrase in phrases:
        found = found | lowered.contains(phrase)
    return F.coalesce(found, F.lit(False))


def injection_hits(text: Column) -> Column:
    """The suspicious phrases a text holds; such a text is flagged, never dropped."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(lowered.contains(p), p) for p in model.INJECTION_PHRASES]))
