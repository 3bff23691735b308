"""Text columns: tokens, sections, passages, keys, HTML, error classes."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

# Words too common to tell documents apart.
STOPWORDS = (
    "aim aims all also and any approach are area areas based between both but can canada canadian data develop "
    "developing development during each faculty field for from goal goals has have high how including intern "
    "internship into its large may method methods model models more most new not novel one other our over project "
    "projects provide research results some student students studies study such supervisor support system systems "
    "team than that the their them then these they this those two under university use used using was well what "
    "when where which who why will with within work working"
).split()
# The form of a term, and of a heading.
TOKEN = r"[a-z][a-z0-9+#.\-]{1,}"
HEADING = r"(?mdU)^(#{1,6})\s+(.+)$"
CEILING, OVERLAP = 12_000, 800
MARK = chr(1)


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once for each row, however often `then` mentions it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def stripped(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column | str) -> Column:
    """Lower-cased terms; stop words go before dots and hyphens are cut from the ends, so "the." stays as "the"."""
    c = F.col(c) if isinstance(c, str) else c
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))
    kept = F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(STOPWORDS))
    return F.transform(kept, lambda t: F.btrim(t, F.lit(".-")))


def content_key(c: Column | str) -> Column:
    return F.substring(F.sha1(c), 1, 16)


def index_text(*fields: str) -> Column:
    """Fields joined by one space each, null as empty."""
    return F.array_join(F.array(*(F.coalesce(F.col(f), F.lit("")) for f in fields)), " ")


def sections(c: Column) -> Column:
    """array<struct<crumb, body>>: one for each heading with its body, a preamble only if it isn't
    blank; without headings the whole text, as it is, with an empty crumb."""
    clean = F.regexp_replace(F.coalesce(c, F.lit("")), MARK, "")

    def section(part: Column, k: Column) -> Column:
        crumb = F.when(k > 0, stripped(F.regexp_extract(part, HEADING, 2))).otherwise("")
        return F.struct(crumb.alias("crumb"), stripped(part).alias("body"))

    def found(parts: Column) -> Column:  # without a heading the one part is the whole text
        many = F.filter(F.transform(parts, section), lambda s: s["body"] != "")
        return F.when(F.size(parts) == 1, F.array(F.struct(F.lit("").alias("crumb"), F.get(parts, F.lit(0)).alias("body")))).otherwise(many)

    return bound(F.split(F.regexp_replace(clean, HEADING, MARK + "$0"), MARK, -1), found)


def slices(body: Column, ceiling: int = CEILING, overlap: int = OVERLAP) -> Column:
    """A text over the ceiling cut to slices that overlap; others as one slice."""
    if ceiling <= overlap:
        raise ValueError("the ceiling must exceed the overlap")
    more = F.ceil((F.length(body) - ceiling) / F.lit(ceiling - overlap)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(more, F.lit(0))), lambda k: F.substring(body, k * (ceiling - overlap) + 1, F.lit(ceiling)))


def packed(found: Column, ceiling: int = CEILING, overlap: int = OVERLAP) -> Column:
    """array<struct<crumb, text>>: whole sections joined by a blank line up to the ceiling; only a
    section over it is cut. A part has the crumb of its first section.

    What fits depends on all that went before, so sections pass one by one, in time linear in the text."""
    if ceiling <= overlap:
        raise ValueError("the ceiling must exceed the overlap")

    def fold(documents: pd.Series) -> pd.Series:  # local, so that it travels whole: executors may lack this package
        done = []
        for sections in documents:
            parts: list[dict[str, str]] = []
            held: list[str] = []
            size, crumb = 0, ""

            def flush() -> None:
                nonlocal size
                text = "\n\n".join(held).strip()
                if text:
                    parts.append({"crumb": crumb, "text": text})
                held.clear()
                size = 0

            for section in sections if sections is not None else ():
                body = section["body"]
                if len(body) > ceiling:
                    flush()
                    begins = range(0, max(len(body) - overlap, 1), ceiling - overlap)
                    parts.extend({"crumb": section["crumb"], "text": body[at : at + ceiling]} for at in begins)
                    continue
                if size == 0 or size + len(body) > ceiling:
                    flush()
                    crumb = section["crumb"]
                    size = len(body)
                else:
                    size += len(body) + 2
                held.append(body)
            flush()
            done.append(parts)
        return pd.Series(done, dtype=object)

    return F.pandas_udf(fold, "array<struct<crumb:string,text:string>>")(found)


# The common entities, in the order of their replacement; a page with any other is unescaped by Python.
ENTITIES = {"&quot;": '"', "&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}

# What may be another reference than the common ones, also without its semicolon.
RARE = r"&(?!(?:quot|copy|middot|lt|gt|#39|nbsp|amp);)(?:#[0-9xX]|[A-Za-z])"


def unescaped(c: Column, rare: Column | None) -> Column:
    """All named, decimal and hex references of HTML 5 replaced, in one pass; only the texts marked as rare go to Python.
    With None for them the common entities alone are replaced."""

    def whole(texts: pd.Series) -> pd.Series:  # local, so that it travels whole: executors may lack this package
        return texts.map(html.unescape, na_action="ignore")

    out = c
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    if rare is None:
        return out
    return F.when(rare, F.pandas_udf(whole, "string")(F.when(rare, c))).otherwise(out)


# The order of the steps below and what each of them matches.
def html_to_text(c: Column, every: bool = True) -> Column:
    """Readable text of a page: scripts and styles go, headings become ``#`` lines, block ends new lines. `every`: all
    references are replaced, else only the common entities with their semicolon, and others stay as written."""
    rare = F.coalesce(c, F.lit("")).rlike(RARE) if every else None  # of the raw page: cutting tags leaves white space, so makes no new reference
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>", " ")
    for n in range(1, 7):
        out = F.regexp_replace(out, rf"(?i)<h{n}[^>]*>", "\n\n" + "#" * n + " ")
    out = F.regexp_replace(out, r"(?i)<br[^>]*>|</(p|div|li|tr)[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    out = F.regexp_replace(unescaped(out, rare), r"[ \t]{2,}", " ")
    return stripped(F.regexp_replace(out, r"\n{3,}", "\n\n"))


# Classes of failures, the first that matches.
ERROR_CLASSES = {
    "rate_limit": r"429|rate.?limit|quota|too many requests",
    "auth": r"401|403|api key|unauthor|forbidden",
    "credits": r"402|credit|billing|payment",
    "bad_model": r"404|model not found|no such model",
    "bad_output": r"json|parse|unparseable|empty response",
    "network": r"timeout|timed out|network|connect",
}


def error_class(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(*(F.when(low.rlike(p), F.lit(k)) for k, p in ERROR_CLASSES.items()), F.lit("other"))


def redacted(c: Column) -> Column:
    """A value that holds anything like a provider's key is replaced whole."""
    return F.when(c.rlike(r"sk-[A-Za-z0-9_-]{8,}|AIza[A-Za-z0-9_-]{10,}"), F.lit("[redacted]")).otherwise(c)
