"""Text expressions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_SIZE, CHUNK_OVERLAP = 512, 20
NAME_MISSING = "Unknown Document"
#: Unicode white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space at either end (all Unicode white space, not only blanks)."""
    return F.trim(_c(x), F.lit(WHITE))


def blank_to_null(x: Column | str) -> Column:
    return F.nullif(_c(x), F.lit(""))


def normalize(x: Column | str) -> Column:
    """Lower case; all but ASCII letters and digits become single blanks."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9]+", " "))


def tokens(x: Column | str) -> Column:
    """Distinct words of a normalised text."""
    return F.array_distinct(F.filter(F.split(_c(x), " "), lambda t: t != ""))


def variants(x: Column | str) -> Column:
    """A normalised text, its singular forms and its words.

    The three rules for plurals are independent: `series` gives `sery` and `serie`.
    """
    t = _c(x)
    n = F.length(t)
    cut = lambda k: F.left(t, n - k)
    forms = F.array(
        t,
        F.when(t.endswith("ies") & (n > 3), F.concat(cut(3), F.lit("y"))),
        F.when(t.endswith("ses") & (n > 3), cut(2)),
        F.when(t.endswith("s") & (n > 2), cut(1)),
    )
    return F.array_distinct(F.filter(F.concat(forms, F.split(t, " ")), lambda v: v.isNotNull() & (v != "")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct words; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def join_nonempty(*parts: Column | str) -> Column:
    """Parts that are neither null nor empty, with blanks between, stripped."""
    return strip(F.array_join(F.filter(F.array(*[_c(p) for p in parts]), lambda p: p.isNotNull() & (p != "")), " "))


def tool_content(context: Column | str, content: Column | str) -> Column:
    return F.concat(_c(context), F.lit("\n\n"), _c(content))


def approx_chunks(x: Column | str) -> Column:
    return F.floor(F.length(_c(x)) / CHUNK_SIZE).cast("long")


def locate_span(text: Column | str, part: Column | str, order: Column | str) -> Column:
    """0-based place of part in text: from where the chunk of this order may start, else anywhere; null if nowhere."""
    text, part, order = _c(text), _c(part), _c(order)
    from_ = F.greatest(F.lit(0), order * (CHUNK_SIZE - CHUNK_OVERLAP) - CHUNK_SIZE).cast("int")
    near, any_ = F.position(part, text, from_ + 1) - 1, F.position(part, text) - 1
    return F.when(part == "", F.lit(None)).when(near >= 0, near).when(any_ >= 0, any_)


def splice(text: Column | str, start: Column, part: Column | str, new: Column | str) -> Column:
    """text with the part that begins at start replaced; text itself if start is null."""
    text, part = _c(text), _c(part)
    done = F.concat(F.substring(text, F.lit(1), start), _c(new), F.substring(text, start + F.length(part) + 1, F.length(text)))
    return F.when(start.isNull(), text).otherwise(done)


def splice_all(text: Column | str, spans: Column | str) -> Column:
    """text with all spans, structs (start, end, new) by start, replaced, the last one first; a span ends at the latest where the next begins."""
    text, spans = _c(text), _c(spans)
    tail = lambda done, at: F.substring(done, at + 1, F.length(done))

    def put(done: Column, span: Column) -> Column:
        end = F.least(span["end"], done["limit"])
        return F.struct(F.concat(F.substring(done["text"], F.lit(1), span["start"]), span["new"], tail(done["text"], end)).alias("text"), span["start"].alias("limit"))

    return F.aggregate(F.reverse(spans), F.struct(text.alias("text"), F.length(text).alias("limit")), put, lambda done: done["text"])


def commit_prompt(action: Column | str, name: Column | str, details: Column | str) -> Column:
    """What a model is asked for a commit message; a line of details only where there are some."""
    details = _c(details)
    line = F.when(F.coalesce(details, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("Details: "), details, F.lit("\n")))
    noun = F.coalesce(blank_to_null(name), F.lit("document"))
    return F.concat(F.lit("Action: "), _c(action), F.lit("\nDocument name: "), noun, F.lit("\n"), line, F.lit("Respond with a single commit message."))


def commit_message(message: Column | str, action: str, noun: Column | str) -> Column:
    """First line of a message, 72 characters at most; `Action noun` if there is none."""
    first = F.element_at(F.split(strip(message), r"\R"), 1)
    return F.coalesce(blank_to_null(F.left(first, F.lit(72))), F.concat(F.lit(action.capitalize() + " "), _c(noun)))


def safe_path(id_: Column | str, name: Column | str) -> Column:
    """documents/{id}_{last part of name}, or document_{id}.txt where there is no name."""
    id_ = _c(id_).cast("string")
    base = blank_to_null(F.regexp_extract(F.coalesce(_c(name), F.lit("")), r"([^/]+)/*$", 1))
    base = F.when(base.isin(".", ".."), F.lit(None)).otherwise(base)
    return F.concat(F.lit("documents/"), id_, F.lit("_"), F.coalesce(base, F.concat(F.lit("document_"), id_, F.lit(".txt"))))


def fill(template: str, chunk: Column | str, content: Column | str) -> Column:
    """{chunk}, then {content}, replaced in this order, so also inside the chunk's text."""
    return F.replace(F.replace(F.lit(template), F.lit("{chunk}"), _c(chunk)), F.lit("{content}"), _c(content))


#: Fixed values.
CONNECTORS = ("Additionally,", "Furthermore,", "In addition,", "Finally,")


def compose(statements: Column | str) -> Column:
    """One text of an array of statements: blank ones skipped, connectors before all but the statement at index 0."""
    s = F.transform(_c(statements), strip)
    tagged = F.filter(F.transform(s, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda t: t["x"].isNotNull() & (t["x"] != ""))
    words = F.array(*[F.lit(c) for c in CONNECTORS])

    def say(t: Column, j: Column) -> Column:
        later = j - F.when(tagged[0]["i"] == 0, F.lit(1)).otherwise(F.lit(0))
        return F.when(t["i"] == 0, t["x"]).otherwise(F.concat(F.element_at(words, F.least(later, F.lit(len(CONNECTORS) - 1)) + 1), F.lit(" "), t["x"]))

    return F.array_join(F.transform(tagged, say), " ")
