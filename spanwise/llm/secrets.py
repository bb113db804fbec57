"""Secret scans with multipart credential linking, in DataFrame functions only.

Three kinds are secrets by themselves: ``assign``, ``access`` and ``hex``. Three weaker kinds (``ident``: account or key
names, ``weak``: unlabelled mixed strings, ``endpoint``: addresses) say little alone. They are reported only where their
complement lies in the same scope (text between blank lines) at most ``reach`` characters away: an ``ident`` beside a secret
part (``assign``, ``hex``, ``weak``), a ``weak`` string beside an access identifier (``access``, ``ident``), an ``endpoint``
beside both. A ``weak`` string inside an address is part of the address and no candidate. The parts of one document never
leave its row: spans of a kind are in order, so the interval join finds the neighbours of a part by binary search in the
arrays, without a shuffle and without pairs.

Whatever a lambda reads besides its element is bound to a lambda variable first (``_bound``): an expression or a column that
the optimizer writes into a lambda would be computed again for each element.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the kinds, in their order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
IDENT = r"""(?i:(client_?id|access_?key(?:_?id)?|user(?:name)?|login|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
WEAK = r"[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"""https?://[^\s"'<>]{4,}|(?i:(?:host|endpoint|server))["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,}"""
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "ident", "weak", "endpoint")
REACH = 200
#: Shortest value of an assignment.
VALUE = 12
_CHUNK = 64
#: Characters of a block that redaction cuts its pieces from.
_BLOCK = 1024
#: Steps of a binary search in an array of any length, the widest first.
_STEPS = f"array({', '.join(str(1 << k) for k in range(30, -1, -1))})"
_SPANS = "array<struct<start:int,end:int,scope:int>>"


def _bound(values: dict[str, Column], body) -> Column:
    """``body`` of the values, each computed once."""
    row = F.struct(*(v.alias(k) for k, v in values.items()))
    return F.get(F.transform(F.array(row), lambda r: body(*(r[k] for k in values))), F.lit(0))


def _folded(a: Column, start: int, step) -> Column:
    return F.aggregate(a, F.lit(start), step)


def _running(values: Column, start: int, step) -> Column:
    """For each number the fold of those before it, by chunks: work n x chunk instead of n x n."""

    def chunked(v: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _CHUNK).cast("int"))
        return F.transform(places, lambda k: F.slice(v, k * _CHUNK + 1, F.lit(_CHUNK)))

    def spread(chunks: Column, folds: Column) -> Column:
        def inside(chunk: Column, k: Column) -> Column:
            first = _folded(F.slice(folds, F.lit(1), k), start, step)
            return _bound({"c": chunk, "f": first}, lambda c, f: F.transform(
                c, lambda _, j: F.aggregate(F.slice(c, F.lit(1), j), f, step)
            ))

        return F.flatten(F.transform(chunks, inside))

    folds = lambda chunks: F.transform(chunks, lambda c: _folded(c, start, step))
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(_bound({"v": values}, lambda v: _bound(
        {"c": chunked(v)}, lambda c: _bound({"c": c, "f": folds(c)}, spread)
    )))


def _before(sizes: Column) -> Column:
    """Exclusive running totals."""
    return _running(sizes, 0, lambda s, x: s + x)


def _spans_of(hits: Column, gaps: Column, good) -> Column:
    """Spans of the matches from what lies between them, those that fail ``good`` left out."""

    def spans(h: Column, g: Column, n: Column, b: Column) -> Column:
        matches = F.transform(h, lambda x, i: F.struct(
            (F.get(b, i) + F.get(g, i)).alias("start"), (F.get(b, i) + F.get(g, i) + F.get(n, i)).alias("end"), x.alias("hit")
        ))
        kept = F.filter(matches, lambda s: good(s["hit"])) if good else matches
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(0).alias("scope")))

    # Before match i lie the gaps up to i and the matches up to i - 1.
    lengths = F.transform(hits, lambda x: F.length(x))
    return _bound({"h": hits, "g": gaps, "n": lengths}, lambda h, g, n: _bound({
        "h": h, "g": g, "n": n, "b": _before(F.zip_with(F.slice(g, F.lit(1), F.size(n)), n, lambda x, y: x + y))
    }, spans))


def _with_spans(df: DataFrame, found: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """A column of spans for each name: pattern and, where given, a condition on the matches."""
    empty = F.array().cast(_SPANS)
    df = df.withColumns({f"__h_{k}": F.regexp_extract_all("__text", F.lit(p), F.lit(0)) for k, (p, _) in found.items()})
    gaps = {k: F.transform(F.split("__text", p, -1), lambda x: F.length(x)) for k, (p, _) in found.items()}
    df = df.withColumns({
        k: F.when(F.size(f"__h_{k}") > 0, _spans_of(F.col(f"__h_{k}"), gaps[k], good)).otherwise(empty) for k, (_, good) in found.items()
    })
    return df.drop(*(f"__h_{k}" for k in found))


def _up_to(starts: Column, x: Column) -> Column:
    """How many of the ascending numbers are at most ``x``, by binary search."""
    return F.aggregate(F.expr(_STEPS), F.lit(0), lambda at, step: F.when(
        (step <= F.size(starts) - at) & (F.get(starts, at + step - 1) <= x), at + step
    ).otherwise(at))


class _Spans:
    """The spans of a kind and their starts, as lambda variables."""

    def __init__(self, spans: Column, starts: Column):
        self.spans, self.starts = spans, starts

    def near(self, part: Column, reach: int) -> Column:
        """Whether a span lies in the part's scope, at most ``reach`` characters from it and outside it.

        Text is no complement of itself: a span that overlaps the part does not count. Spans of a kind do not overlap, so of
        those before the part only the last two can be the nearest outside, and the first that starts at or after its end.
        """

        def close(o: Column) -> Column:
            return F.coalesce(
                (o["scope"] == part["scope"]) & (o["end"] + reach >= part["start"]) & (o["start"] <= part["end"] + reach)
                & ((o["end"] <= part["start"]) | (o["start"] >= part["end"])), F.lit(False)
            )

        at, after = _up_to(self.starts, part["start"]), _up_to(self.starts, part["end"] - 1)
        around = _bound({"at": at}, lambda x: F.array(F.get(self.spans, x - 1), F.get(self.spans, x - 2)))
        return F.exists(around, close) | close(F.get(self.spans, after))

    def overlaps(self, part: Column) -> Column:
        at = _up_to(self.starts, part["start"])
        return F.coalesce(F.get(self.spans, at - 1)["end"] > part["start"], F.lit(False)) | F.coalesce(
            F.get(self.spans, at)["start"] < part["end"], F.lit(False)
        )


def _either(checks: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, checks)


def _kept(k: str, others: tuple[str, ...], keep) -> Column:
    """The spans of ``k`` for which ``keep`` of the span and the other kinds' spans holds."""
    values = {f"{x}_{o}": F.col(o) if x == "s" else F.transform(o, lambda s: s["start"]) for o in others for x in "sb"}

    def body(own: Column, *given: Column) -> Column:
        kinds = {o: _Spans(given[2 * n], given[2 * n + 1]) for n, o in enumerate(others)}
        return F.filter(own, lambda p: keep(p, kinds))

    return F.when(F.size(k) > 0, _bound({"own": F.col(k), **values}, body)).otherwise(F.col(k))


def _linked(reach: int) -> dict[str, Column]:
    """The weak parts whose complement co-occurs."""
    identifiers, parts = ("access", "ident"), ("assign", "hex", "weak")

    def beside(*groups: tuple[str, ...]):
        return lambda p, kinds: reduce(lambda a, b: a & b, [_either([kinds[o].near(p, reach) for o in g]) for g in groups])

    return {
        "ident": _kept("ident", parts, beside(parts)), "weak": _kept("weak", identifiers, beside(identifiers)),
        "endpoint": _kept("endpoint", identifiers + parts, beside(identifiers, parts)),
    }


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``docs`` with an array of spans (start, end in code points, end exclusive; scope) for each of ``KINDS``.

    Columns of these names are replaced. The base kinds hold leftmost non-overlapping matches, each kind by itself. A null
    text is an empty one and holds nothing. Rows are handled one by one, so repeated rows give repeated results; one very
    long text costs its own row only, in nearly linear time. A linked weak part may overlap other weak parts, but no base
    span; a ``weak`` string that overlaps an address is dropped. Whether a part is linked does not depend on whether its
    complements are linked themselves.
    """
    df = docs.withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = _with_spans(df, {
        "assign": (ASSIGN, lambda x: F.length(F.regexp_extract(x, ASSIGN, 2)) >= VALUE),
        "access": (ACCESS, None),
        "hex": (HEX, None),
        "ident": (IDENT, None),
        "weak": (WEAK, lambda x: x.rlike("[A-Z]") & x.rlike("[a-z]") & x.rlike("[0-9]")),
        "endpoint": (ENDPOINT, None),
    })
    some_weak = F.size("ident") + F.size("weak") + F.size("endpoint") > 0
    # Scopes are numbered by the blank lines before them; a text without weak parts needs none.
    blank = "\n[ \t\r]*\n"
    df = df.withColumn("__blank", F.when(some_weak, F.regexp_extract_all("__text", F.lit(blank), F.lit(0))))
    between = F.transform(F.split("__text", blank, -1), lambda x: F.length(x))
    breaks = _bound({"h": F.transform("__blank", lambda x: F.length(x)), "g": between}, lambda h, g: F.zip_with(
        _before(F.zip_with(F.slice(g, F.lit(1), F.size(h)), h, lambda a, b: a + b)), F.slice(g, F.lit(1), F.size(h)), lambda a, b: a + b
    ))
    df = df.withColumn("__breaks", F.when(F.size("__blank") > 0, breaks).otherwise(F.array().cast("array<int>")))
    df = df.withColumns({k: F.when(some_weak, _bound({"own": F.col(k), "at": F.col("__breaks")}, lambda own, at: F.transform(
        own, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _up_to(at, s["start"]).alias("scope"))
    ))).otherwise(F.col(k)) for k in KINDS})
    free = lambda p, kinds: ~_either([o.overlaps(p) for o in kinds.values()])
    df = df.withColumns({k: _kept(k, (*BASE, "endpoint") if k == "weak" else BASE, free) for k in KINDS[3:]})
    return df.withColumns(_linked(reach)).drop("__text", "__blank", "__breaks")


def listed(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of the spans, by start, then by kind as listed, comma-joined."""

    def named(n: int, k: str) -> Column:
        return F.transform(k, lambda s: F.struct(
            s["start"].alias("start"), F.lit(n).alias("kind"), F.concat_ws(":", F.lit(k), s["start"], s["end"]).alias("text")
        ))

    parts = F.flatten(F.array(*(named(n, k) for n, k in enumerate(kinds))))
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), ",")


def redacted(docs: DataFrame, mark: str = "[secret]", reach: int = REACH) -> DataFrame:
    """``docs`` with each run of overlapping reported spans replaced by ``mark``; ``n_chars`` follows where it is a column.

    A null text stays null. Texts without a reported span, and all other columns, stay as they are.
    """
    found = scan(docs.withColumn("__row", F.struct("*")), reach)
    spans = F.array_sort(F.flatten(F.array(*(F.transform(k, lambda s: F.struct(s["start"], s["end"])) for k in KINDS))))
    found = found.select("__row", spans.alias("__spans")).withColumn("__t", F.col("__row.text").cast("string"))
    text = F.when(F.size("__spans") > 0, _without("__t", "__spans", mark)).otherwise(F.col("__t"))
    found = found.select("__row", text.alias("__new"))
    columns = [F.col("__new").alias(c) if c == "text" else F.length("__new").cast("long").alias(c) if c == "n_chars" else F.col("__row")[c].alias(c) for c in docs.columns]
    return found.select(columns)


def _without(text: str, spans: str, mark: str) -> Column:
    """The text with ``mark`` for each run of overlapping or adjoining spans; the spans are in order."""

    def runs(s: Column, e: Column) -> Column:
        # A run starts where a span starts after the furthest end before it; that end closes the run before.
        with_ends = F.transform(s, lambda x, i: F.struct(x["start"].alias("start"), F.get(e, i).alias("last")))
        return F.filter(with_ends, lambda x: x["start"] > x["last"])

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        """Characters a to b, from the blocks that hold them."""
        places = F.sequence(F.floor(a / _BLOCK).cast("int"), F.floor((b - 1) / _BLOCK).cast("int"))
        parts = F.transform(places, lambda k: F.substring(
            F.get(blocks, k), F.greatest(a - k * _BLOCK, F.lit(0)) + 1, F.least(b - k * _BLOCK, F.lit(_BLOCK)) - F.greatest(a - k * _BLOCK, F.lit(0))
        ))
        return F.when(b > a, F.array_join(parts, "")).otherwise(F.lit(""))

    def joined(r: Column, blocks: Column, last: Column, size: Column) -> Column:
        # Before a run lies what follows the end of the run before it, from 0 for the first.
        before = F.transform(r, lambda x: cut(blocks, F.greatest(x["last"], F.lit(0)), x["start"]))
        return F.concat(F.array_join(F.transform(before, lambda p: F.concat(p, F.lit(mark))), ""), cut(blocks, last, size))

    ends = _running(F.transform(spans, lambda s: s["end"]), -1, lambda m, x: F.greatest(m, x))
    return _bound({"s": F.col(spans), "e": ends}, lambda s, e: _bound({
        "r": runs(s, e), "b": F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)),
        "last": F.array_max(F.transform(s, lambda x: x["end"])), "size": F.length(text),
    }, joined))
