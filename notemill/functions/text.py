"""Text columns: normalisation, capture grammar, cleaning, segmentation, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str.split / str.strip / unicode \s see it, that is the
# Unicode White_Space property and the four separators 1c-1f. As a property test it is several
# times faster in the regex engine than a list of ranges. WS may stand anywhere in a pattern.
WS = r"(?U:[\s\x1c-\x1f])"
_WS_RUN = r"(?U)[\s\x1c-\x1f]+"
_WS_CHARS = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
    0x205F, 0x3000,
]))
# Word characters as Python's unicode \w sees them.
WORD = r"\p{L}\p{N}_"

# The capture grammar.
TAG_PATTERN = r"#([a-zA-Z_][a-zA-Z0-9_]*)"
COMMENT_PATTERN = r"(?d)//(.+)"
TIMESTAMP_PATTERN = r"(?U)@(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?)"


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``."""
    return F.btrim(c, F.lit(_WS_CHARS))


def squeeze_ws(c: Column) -> Column:
    """Every whitespace run becomes one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, _WS_RUN, " "))


def words(c: Column) -> Column:
    """Whitespace tokens; blank text gives an empty array."""
    return F.array_remove(F.split(squeeze_ws(c), " "), "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def normalize_text(c: Column) -> Column:
    """Collapse whitespace, lower-case, delete quotes, ``!`` to ``.``, strip."""
    c = F.lower(squeeze_ws(c))
    for char, other in (('"', ""), ("'", ""), ("!", ".")):
        c = F.replace(c, F.lit(char), F.lit(other))
    return F.trim(c)


# --- capture grammar -------------------------------------------------------

def extract_tags(c: Column) -> Column:
    """All ``#tag`` names, first-seen order, without repeats."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(TAG_PATTERN), F.lit(1)))


def extract_comment(c: Column) -> Column:
    """Text after the first ``//`` up to the end of its line, stripped; NULL if there is none."""
    return F.when(F.regexp_like(c, F.lit(COMMENT_PATTERN)),
                  strip_ws(F.regexp_extract(c, COMMENT_PATTERN, 1)))


def extract_timestamp(c: Column) -> Column:
    """First ``@YYYY-MM-DDThh:mm:ss[.f]``; NULL if there is none. Only the shape is checked."""
    return F.nullif(F.regexp_extract(c, TIMESTAMP_PATTERN, 1), F.lit(""))


def _delete_literal(text: Column, literal: Column) -> Column:
    # \Q..\E would end early inside a literal that holds \E itself
    quoted = F.concat(F.lit("\\Q"), F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.regexp_replace(text, F.concat(quoted, F.lit(f"{WS}*")), F.lit(""))


def extract_body(c: Column, tags: Column, comment: Column, timestamp: Column) -> Column:
    """Raw text without tags (in tag order), comment and timestamp, whitespace squeezed."""
    no_tags = F.aggregate(
        tags, c, lambda acc, tag: F.regexp_replace(acc, F.concat(F.lit("#"), tag, F.lit(f"{WS}*")), F.lit(""))
    )
    has_comment = comment.isNotNull() & (comment != "")
    no_comment = F.when(has_comment, _delete_literal(no_tags, F.concat(F.lit("//"), comment))).otherwise(no_tags)
    no_ts = F.when(timestamp.isNotNull(),
                   _delete_literal(no_comment, F.concat(F.lit("@"), timestamp))).otherwise(no_comment)
    return squeeze_ws(no_ts)


# --- cleaning --------------------------------------------------------------

def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]*>", "")


def clean_text(c: Column, remove_html: bool = True, normalize_whitespace: bool = True,
               remove_special_chars: bool = False, lowercase: bool = False) -> Column:
    """Markup, special characters, case and whitespace, each behind its switch."""
    if remove_html:
        c = strip_html(c)
    if remove_special_chars:
        c = F.regexp_replace(c, rf"[^{WORD}.,!?\-\t-\r\x1c-\x20\x85\xa0]", "")
    if lowercase:
        c = F.lower(c)
    return squeeze_ws(c) if normalize_whitespace else c


def normalize_content(c: Column) -> Column:
    """Line endings to ``\\n``, space runs to one, typographic punctuation to ASCII."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    # Curly quotes, dashes, ellipsis
    c = F.translate(c, "\u2018\u2019\u201c\u201d\u2013\u2014", "''\"\"--")
    return F.replace(c, F.lit("\u2026"), F.lit("..."))


def sanitize_content(c: Column) -> Column:
    """Drop script blocks and script URLs, escape the four markup characters."""
    c = F.regexp_replace(c, r"(?is)<script.*?</script\s*>", "")
    c = F.regexp_replace(c, r"(?i)<script[^>]*>|javascript:|data:", "")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def decoded(c: Column) -> Column:
    """Bytes as text: struct of the text, with U+FFFD for what is not valid UTF-8, and whether all of it was valid."""
    raw = c.cast("string")
    return F.struct(F.make_valid_utf8(raw).alias("text"), F.is_valid_utf8(raw).alias("valid"))


def sanitize_bytes(c: Column) -> Column:
    """Struct of the sanitised text and whether the bytes were valid UTF-8; sanitising never sees broken text."""
    text = decoded(c)
    return F.struct(sanitize_content(text["text"]).alias("content"), text["valid"].alias("valid"))


def fix_content(c: Column, max_length: int = 10_000, min_length: int = 10) -> Column:
    """Repair content that would fail validation: strip markup, shorten, mark short texts."""
    c = F.regexp_replace(c, r"<[^>]+>", "")
    c = F.when(F.length(c) > max_length, F.concat(F.substring(c, 1, max_length), F.lit("..."))).otherwise(c)
    return F.when(F.length(c) < min_length, F.concat(c, F.lit(" [Content too short]"))).otherwise(c)


# Our own patterns; the specification asks for redaction without listing rules.
PII_PATTERNS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[IP]"),
    (r"\+?[0-9][0-9 ()-]{7,}[0-9]", "[PHONE]"),
)


def redact_pii(c: Column) -> Column:
    (mail, mail_mark), *rest = PII_PATTERNS
    # the mail pattern is the slow one; texts without its sign skip it
    c = F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, mail, mail_mark)).otherwise(c)
    for pattern, mark in rest:
        c = F.regexp_replace(c, pattern, mark)
    return c


def normalize_tag_list(tags: Column, max_tags: int = 10, max_length: int = 50) -> Column:
    """Lower-case, keep ``^[a-z0-9-]+$`` up to 50 characters, no repeats, at most ten."""
    lowered = F.transform(tags, lambda t: F.lower(t))
    allowed = F.filter(lowered, lambda t: F.regexp_like(t, F.lit(r"^[a-z0-9-]+$")) & (F.length(t) <= max_length))
    return F.slice(F.array_distinct(allowed), 1, max_tags)


def paragraphs(c: Column) -> Column:
    """Stripped non-blank paragraphs (blank line separated)."""
    parts = F.transform(F.split(c, "\n\n"), strip_ws)
    return F.filter(parts, lambda p: p != "")


def chunks(c: Column, max_length: int = 1000, overlap: int = 0) -> Column:
    """Cut into pieces of ``max_length`` characters, each starting ``max_length - overlap`` later."""
    if not 0 <= overlap < max_length:
        raise ValueError("overlap must be at least 0 and below max_length")
    step = max_length - overlap
    # the last start is the first one whose piece reaches the end of the text
    last = F.greatest(F.ceil((F.length(c) - overlap) / F.lit(step)).cast("int") - 1, F.lit(0)) * step
    starts = F.sequence(F.lit(0), last, F.lit(step))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(starts, lambda s: F.substring(c, s + 1, F.lit(max_length)))
    )


def segments(c: Column, max_length: int = 1000, overlap: int = 0) -> Column:
    """Paragraphs, with those over the limit cut into chunks."""
    return F.flatten(F.transform(paragraphs(c), lambda p: chunks(p, max_length, overlap)))


def tag_definition_text(description: Column, examples: Column) -> Column:
    return F.concat(description, F.lit(" "), F.array_join(examples, " "))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)
