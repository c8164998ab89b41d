"""Text normal forms and small text functions, all native Column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioscope.functions import values as V

WORD = r"\p{L}\p{N}_"  # the characters of a word, in any script
BLANK = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
TRIM_CHARS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u2028\u2029\u3000"


def as_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row, for use inside higher-order functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_all(c, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(as_column(c), F.lit(pattern), F.lit(group))


def words_of(c) -> Column:
    """Split on blanks, as an array without empty strings."""
    return F.filter(F.split(as_column(c), BLANK + "+"), lambda w: w != "")


def strip(c, extra: str = "") -> Column:
    return F.trim(as_column(c), F.lit(TRIM_CHARS + extra))


def rstrip(c, extra: str = "") -> Column:
    return F.rtrim(as_column(c), F.lit(TRIM_CHARS + extra))


# ------------------------------------------------------------------------------- fold and flat


def fold_char(ch: str) -> str:
    plain = (c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
    return "".join(plain).casefold()


# Latin, combining marks, Greek, Cyrillic, punctuation, letter-like signs, ligatures, full width
_FOLDED_RANGES = (
    (0x80, 0x250), (0x300, 0x530), (0x1E00, 0x2070), (0x2100, 0x2150), (0xFB00, 0xFB07), (0xFF01, 0xFF5F),
)


@lru_cache(maxsize=1)
def _fold_rules() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(characters, their one-character folds, [(character, longer fold)]) from the Unicode tables."""
    ones, dropped, longer = {}, [], []
    for lo, hi in _FOLDED_RANGES:
        for code in range(lo, hi):
            ch = chr(code)
            out = fold_char(ch)
            if out == ch:
                continue
            if not out:
                dropped.append(ch)
            elif len(out) == 1:
                ones[ch] = out
            else:
                longer.append((ch, out))
    return "".join(ones) + "".join(dropped), "".join(ones.values()), tuple(longer)


def fold(c) -> Column:
    """Case and accents ignored. Pure-ASCII text takes a short path with no table lookups."""
    if not isinstance(c, str):
        return let(c, _folded)  # computed once, however long the expression
    return _folded(F.col(c))


def _folded(c: Column) -> Column:
    source, target, longer = _fold_rules()
    common = [(a, b) for a, b in longer if ord(a) < 0x250 or a in "…™ﬀﬁﬂﬃﬄ"]
    spelled = c
    for a, b in common:
        spelled = F.replace(spelled, F.lit(a), F.lit(b))
    # the range comes first, so that other characters are told by one comparison instead of one for each sign
    spelled = F.when(c.rlike("[\u00bc-\uffff&&[" + "".join(a for a, _ in common) + "]]"), spelled).otherwise(c)
    wide = F.lower(F.translate(spelled, source, target))
    ascii_only = F.octet_length(c) == F.length(c)
    return strip(F.when(ascii_only, F.lower(c)).otherwise(wide))


def fold_any_script(c) -> Column:
    """`fold` for every script, the ones outside the native table included (Arrow batches)."""

    def one(text):
        if text is None:
            return None
        plain = "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))
        return plain.casefold().strip()

    # made per call: a function of the module would keep its JVM object, and with it no later job could pickle this module
    @F.pandas_udf(StringType())
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return folded(as_column(c))


def flat(c) -> Column:
    """`fold` with every run of blanks as one space."""
    return flatten(fold(c))


def flatten(c) -> Column:
    return F.trim(F.regexp_replace(as_column(c), BLANK + "+", " "))


# ----------------------------------------------------------------------------- counting in a row


def run_counts(tokens: Column) -> Column:
    """Distinct tokens of an array with count and first position: array<struct<term,n,pos>>.

    Sorts the array and cuts it into runs, so it is n log n inside one row and needs no shuffle.
    """
    tagged = F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("p"))))

    def heads(rows):
        at = F.transform(rows, lambda x, i: F.struct(x["t"].alias("t"), x["p"].alias("p"), i.alias("at")))
        return F.filter(at, lambda x: ~x["t"].eqNullSafe(F.get(rows, x["at"] - 1)["t"]))

    def counts(rows):
        return let(
            heads(rows),
            lambda hs: F.transform(
                hs,
                lambda h, i: F.struct(
                    h["t"].alias("term"),
                    (F.coalesce(F.get(hs, i + 1)["at"], F.size(rows)) - h["at"]).alias("n"),
                    h["p"].alias("pos"),
                ),
            ),
        )

    return let(tagged, counts)


def keywords(c, n: int = 20, folded: bool = False) -> Column:
    """The n most said words (4+ plain letters, no stopwords); ties go to the one said first."""
    text = as_column(c) if folded else fold(c)
    tokens = F.filter(find_all(text, "[a-z]{4,}"), lambda t: ~t.isin(*V.SEARCH_STOPWORDS))
    ranked = F.sort_array(
        F.transform(
            run_counts(tokens),
            lambda r: F.struct((-r["n"]).alias("k"), r["pos"].alias("pos"), r["term"].alias("term")),
        )
    )
    return F.transform(F.slice(ranked, 1, n), lambda r: r["term"])


def index_tokens(c) -> Column:
    return find_all(fold(c), r"[\p{L}\p{N}]+")


# --------------------------------------------------------------------------------- word forms


def stem(word) -> Column:
    """One ending off a folded word, the longest that leaves four letters or more."""
    return F.regexp_replace(as_column(word), "^(.{4,}?)(?:" + "|".join(V.STEM_ENDINGS) + ")$", "$1")


def number_norm(token) -> Column:
    """One form for a number: marks between groups of three digits go, and a comma before other digits becomes a point."""
    token = as_column(token)
    grouped = token.rlike(r"^\d{1,3}(?:[.,]\d{3})+$")
    return F.when(grouped, F.regexp_replace(token, "[.,]", "")).otherwise(F.replace(token, F.lit(","), F.lit(".")))


def term_key(c) -> Column:
    """The key two spellings of a glossary term share; a short acronym ignores letter order."""
    c = as_column(c)
    words = F.trim(F.regexp_replace(fold(c), f"[^{WORD}]+", " "))
    upper = (F.upper(c) == c) & (F.lower(c) != c)
    letters = F.array_join(F.sort_array(F.split(words, "")), "")
    return F.when(upper & (F.length(words) <= 5), letters).otherwise(words)


def content_hash(c) -> Column:
    return F.substring(F.sha2(as_column(c).cast("binary"), 256), 1, 16)


# ------------------------------------------------------------------------- titles and sentences


def safe_title(c, max_chars: int = 100, max_bytes: int = 240) -> Column:
    """A title usable as a file name and link target: at most 100 characters and 240 bytes."""
    shown = F.regexp_replace(as_column(c), r"[\p{Cc}\p{Cf}]", "")
    plain = F.regexp_replace(shown, r'[\[\]#|^:/\\?*"<>]', " ")
    cut = F.substring(F.trim(F.regexp_replace(plain, BLANK + "+", " "), F.lit(" .")), 1, max_chars)

    def by_bytes(text):
        start = F.struct(F.lit("").alias("kept"), F.lit(False).alias("full"))

        def step(acc, ch):
            longer = F.concat(acc["kept"], ch)
            full = acc["full"] | (F.octet_length(longer) > max_bytes)
            return F.struct(F.when(full, acc["kept"]).otherwise(longer).alias("kept"), full.alias("full"))

        return F.aggregate(F.split(text, ""), start, step, lambda acc: acc["kept"])

    fitted = F.when(F.octet_length(cut) <= max_bytes, cut).otherwise(by_bytes(cut))
    return F.trim(fitted, F.lit(" ."))


def slugify(c, max_chars: int = 60) -> Column:
    c = as_column(c)
    slug = F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), F.lit("-"))
    other_script = F.concat(F.lit("x-"), F.substring(F.sha1(strip(c).cast("binary")), 1, 10))
    cut = F.trim(F.substring(slug, 1, max_chars), F.lit("-"))
    return F.when((slug == "") & (strip(c) != ""), other_script).when(cut == "", F.lit("untitled")).otherwise(cut)


def one_line(c, max_chars: int = 160) -> Column:
    text = flatten(c)
    cut = F.concat(F.rtrim(F.substring(text, 1, max_chars - 1)), F.lit("…"))
    return F.when(F.length(text) <= max_chars, text).otherwise(cut)


def first_sentence(c, max_chars: int = 160) -> Column:
    """The first sentence, cut at a word boundary; NULL when too short to say anything."""

    def cut(whole):
        head = F.substring(whole, 1, max_chars - 1)
        shorter = F.concat(F.rtrim(F.regexp_replace(head, r" [^ ]*$", ""), F.lit(" ,;:")), F.lit("…"))
        return F.when(F.length(whole) > max_chars, shorter).otherwise(whole)

    # each step is read several times: the whole text is flattened and searched once
    whole = F.regexp_extract(flatten(c), r"^(?:.*?[.!?](?= )|.*)", 0)
    return let(let(whole, cut), lambda sentence: F.when((F.length(sentence) >= 10) & sentence.contains(" "), sentence))


def complete(c) -> Column:
    """Text cut off mid-sentence ends at its last whole sentence, if that is half of it or more."""
    text = rstrip(c)
    whole = F.regexp_extract(text, r"(?s)^(.*[.!?…])", 1)
    long_enough = (whole != "") & (F.length(whole) - 1 >= F.length(text) * 0.5)
    return F.when(text.rlike(r'[.!?…"»)]\z') | ~long_enough, text).otherwise(whole)


SENTENCE_END = r"(?<=[.!?])\s+(?=[\[\"“¿¡(]*[A-ZÁÉÍÓÚÑ\d])|\n+"


def sentences(c) -> Column:
    """Sentences and list items; a bare `1.` stays with the item it heads."""
    c = as_column(c)
    head = r"^\s*\d+[.)]$"
    parts = F.split(c, SENTENCE_END)

    def glue(pieces, seps):
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("carry"))

        def step(acc, i):
            piece = F.concat(acc["carry"], F.get(pieces, i))
            held = piece.rlike(head) & (i < F.size(seps))
            return F.struct(
                F.when(held, acc["out"]).otherwise(F.concat(acc["out"], F.array(piece))).alias("out"),
                F.when(held, F.concat(piece, F.get(seps, i))).otherwise(F.lit("")).alias("carry"),
            )

        return F.aggregate(F.sequence(F.lit(0), F.size(pieces) - 1), start, step, lambda acc: acc["out"])

    numbered = let(parts, lambda ps: let(find_all(c, SENTENCE_END), lambda seps: glue(ps, seps)))
    return F.when(F.exists(parts, lambda p: p.rlike(head)), numbered).otherwise(parts)


def link_targets(c) -> Column:
    """Page names linked from text, in order: `[[Title]]`, `[[Title|shown]]`, `[[Title#Part]]`."""
    return F.transform(find_all(c, r"\[\[([^\]|#]+)", 1), lambda t: strip(t))


# --------------------------------------------------------------------------- cleaning raw text


def sanitize_text(c, drop_control: bool = True) -> Column:
    """Text a viewer may show: no control characters, no HTML, no image syntax."""
    c = as_column(c)
    if drop_control:
        c = F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", "")
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit("!["), F.lit("["))


# fixed values: the tags and chat markers that untrusted text must not be able to forge
FORGED_TAG = (
    r"(?i)<(?=/?(?:source|existing_pages|chunk|chunk_notes|section_notes|new_source|sections?|page"
    r"|question|concept)\b|\||<?/?SYS>)"
)


def fence_safe(c) -> Column:
    return F.regexp_replace(F.regexp_replace(as_column(c), FORGED_TAG, "‹"), r"(?i)\[/?INST\]", "(INST)")


def clean_mail_text(c) -> Column:
    """Drop invisible padding, trailing blanks and the empty lines they leave."""
    seen = F.regexp_replace(as_column(c), r"[\u034f\u200b-\u200f\u2060\u00ad\ufeff]", "")
    lines = F.regexp_replace(F.regexp_replace(seen, r"\r\n?", "\n"), r"[ \t\x0b\x0c\u00a0]+(?=\n|\z)", "")
    return strip(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def clean_text(c) -> Column:
    """Ligatures spelled out, control characters removed."""
    c = as_column(c)
    for sign, letters in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        c = F.replace(c, F.lit(sign), F.lit(letters))
    return strip(F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f\ufffd]", ""))


def file_title(c) -> Column:
    """A readable title from a file name without its extension."""
    bare = F.regexp_replace(as_column(c), r"(?i)\.(pptx?|docx?|key|odp)$", "")
    dashed = F.when(bare.contains(" "), bare).otherwise(F.replace(bare, F.lit("-"), F.lit(" ")))
    return flatten(F.replace(dashed, F.lit("_"), F.lit(" ")))


def shown_title(meta_title, first_pages) -> Column:
    """The metadata title if its words stand on the first pages, else an empty string."""

    def plain(c):
        return F.array_join(find_all(fold_width(c), f"[{WORD}]+"), " ")

    wanted = plain(meta_title)
    return F.when((wanted != "") & plain(first_pages).contains(wanted), strip(meta_title)).otherwise(F.lit(""))


@lru_cache(maxsize=1)
def _width_rules() -> tuple[str, str]:
    pairs = {}
    for lo, hi in ((0xFF01, 0xFF5F), (0x2000, 0x200B), (0xA0, 0xA1)):
        for code in range(lo, hi):
            out = unicodedata.normalize("NFKC", chr(code))
            if len(out) == 1 and out != chr(code):
                pairs[chr(code)] = out
    return "".join(pairs), "".join(pairs.values())


def fold_width(c) -> Column:
    """Compatibility forms and case, accents kept."""
    source, target = _width_rules()
    c = as_column(c)
    for sign, letters in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ß", "ss")):
        c = F.replace(c, F.lit(sign), F.lit(letters))
    return F.lower(F.translate(c, source, target))


def quote_timestamp(text, url, kind, needle) -> Column:
    """For a video: the address of the moment its transcript says `needle`; else NULL."""
    text, url = as_column(text), as_column(url)
    row = r"(?m)^\*\*(\d+(?::\d{2}){1,2})\*\* · (.*)$"
    rows = F.arrays_zip(find_all(text, row, 1).alias("at"), find_all(text, row, 2).alias("said"))
    stamp = let(
        flat(needle), lambda wanted: F.get(F.filter(rows, lambda r: flat(r["said"]).contains(wanted)), F.lit(0))["at"]
    )
    seconds = F.aggregate(F.split(stamp, ":"), F.lit(0), lambda acc, p: acc * 60 + p.cast("int"))
    joiner = F.when(url.contains("?"), "&").otherwise("?")
    usable = (as_column(kind) == "video") & url.startswith("http") & stamp.isNotNull()
    return F.when(usable, F.concat(url, joiner, F.lit("t="), seconds.cast("string"), F.lit("s")))


def any_literal(texts) -> str:
    """An alternation of fixed strings for use inside a Java regex."""
    return "|".join(re.escape(t) for t in texts)
