"""Secret scans with SQL functions only: three base patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of a character class: base64-like `[A-Za-z0-9+/_=-]` of at least ENTROPY_WINDOW characters, or
hexadecimal `[0-9a-fA-F]` of as many. The entropy of each window of ENTROPY_WINDOW characters comes from the one before
by taking the leaving character's count down and the entering one's up: aggregate() carries the counts, packed into
eight numbers, and the sum of c * log2 c. Every step is linear in the length of the text and in the number of matches.
A candidate is a span of kind `entropy` when its highest window reaches the limit of its class and the allow-list does
not suppress it: runs without a digit, UUIDs, repeated or counted-up alphabets, paths and web addresses. Spans that a
base span covers are not given twice. Each text is a row-local projection: no shuffle, no Python.

Positions are code points, ends exclusive. Defined cases: null text is an empty text (no spans). Ties in start are put in
the order assign, access, hex, entropy. Repeated rows and other columns do not matter; an empty table gives none.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three base patterns.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

ENTROPY_WINDOW = 20
#: Bits a character that the best window must reach, by class.
BASE64_BITS, HEX_BITS = 3.55, 2.95
BASE64_RUN = r"[A-Za-z0-9+/_=-]{20,}"
HEX_RUN = r"[0-9a-fA-F]{20,}"
#: Runs that are no secrets, whatever their entropy.
ALLOWED = (
    r"^[^0-9]*$",  # no digit: words, names
    r"^[0-9_=+/-]*$",  # no letter: numbers, dates, rules
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"(?i)0123456789|abcdefghij|example|^(.)\1*$",
)
#: Paths and slugs are allowed too: two words at least that a mark ends, and maybe a last one. Judged piece by piece, as a
#: pattern of a repeated group would recurse once for each piece of a long run.
SLUG_WORD, SLUG_LAST, SLUG_MARK = r"^[a-z]+[0-9]{0,4}$", r"^[a-z]*[0-9]{0,4}$", "[/_-]"

SPAN = "struct<start:int,kind:int,end:int>"
MATCH = "struct<start:int,match:string>"
#: A running pass keeps its results in groups of so many, so that adding one never copies all earlier ones.
GROUP = 512
#: Texts are cut into stretches of so many code points once, so that reading a part never starts at the text's beginning.
STRETCH = 4096
#: Counts of a window's characters: COUNT_BITS bits each, PER_LONG of them in each of LONGS numbers; `+` to `z` are cells 0 to 79.
COUNT_BITS, PER_LONG, LONGS, FIRST_CODE = 6, 10, 8, 43


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once, however often use() reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, zero: Column, step, give, kind: str) -> Column:
    """array<kind> of give(state, item) for each item, state being zero at first and then step(state, item)."""
    none = F.array().cast(f"array<{kind}>")

    def inner(s, x):
        return F.struct(step(s["at"], x).alias("at"), F.array_append(s["out"], give(s["at"], x)).alias("out"))

    def outer(s, group):
        part = F.aggregate(group, F.struct(s["at"].alias("at"), none.alias("out")), inner)
        return _once(part, lambda p: F.struct(p["at"].alias("at"), F.array_append(s["out"], p["out"]).alias("out")))

    def whole(every):
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / GROUP).cast("int")), lambda g: F.slice(every, g * GROUP + 1, F.lit(GROUP)))
        start = F.struct(zero.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(every) > 0, F.flatten(F.aggregate(groups, start, outer)["out"])).otherwise(none)

    return _once(items, whole)


def matches(text: Column, pattern: str, present: str) -> Column:
    """array<MATCH> of the non-overlapping matches, found by splitting; `present` is a cheap first test."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    # the start of a match: all pieces up to it and all matches before it
    places = _once(
        F.struct(found.alias("found"), between.alias("between")),
        lambda x: running(
            F.slice(F.arrays_zip(x["found"].alias("match"), x["between"].alias("before")), F.lit(1), F.size(x["found"])),
            F.lit(0),
            lambda at, m: at + F.length(m["before"]) + F.length(m["match"]),
            lambda at, m: F.struct((at + F.length(m["before"])).cast("int").alias("start"), m["match"].alias("match")),
            MATCH,
        ),
    )
    return F.when(text.rlike(present), places).otherwise(F.array().cast(f"array<{MATCH}>"))


def _spans(found: Column, kind: int, keep=None) -> Column:
    kept = F.filter(found, lambda m: keep(m["match"])) if keep else found
    return F.transform(kept, lambda m: F.struct(m["start"].cast("int").alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["match"])).cast("int").alias("end")))


def best_entropy(run: Column, window: int = ENTROPY_WINDOW) -> Column:
    """Highest Shannon entropy (bits a character) of the windows of the run, or of the whole run if it is shorter.

    The run has characters of the base64-like class only. State: the counts of the window's characters, packed; w, the sum
    of c * log2(c) over them; and the least w so far. A step adds the entering character, takes the leaving one off, and
    reads no other. Entropy = log2(n) - w / n.
    """
    assert 0 < window < 1 << COUNT_BITS
    term = F.array(*(F.lit(c * math.log2(c) if c > 1 else 0.0) for c in range(window + 2)))
    names = [f"c{j}" for j in range(LONGS)]

    def cell(raw: Column, i: Column) -> Column:
        code = F.ascii(F.substring(raw, i, F.lit(1)).cast("string")) - FIRST_CODE
        return F.struct(F.floor(code / PER_LONG).cast("int").alias("long"), (code % PER_LONG * COUNT_BITS).cast("int").alias("shift"))

    def count(s: Column, at: Column) -> Column:
        held = F.element_at(F.array(*(s[c] for c in names)), at["long"] + 1)
        return F.call_function("shiftright", held, at["shift"]).bitwiseAND((1 << COUNT_BITS) - 1).cast("int")

    def changed(s: Column, at: Column, by: int, terms: Column, on: Column) -> Column:
        one = F.call_function("shiftleft", F.lit(by).cast("long"), at["shift"])
        c = count(s, at)
        w = s["w"] + F.get(terms, c + by) - F.get(terms, c)
        now = [F.when(on & (at["long"] == j), s[n] + one).otherwise(s[n]).alias(n) for j, n in enumerate(names)]
        return F.struct(F.when(on, w).otherwise(s["w"]).alias("w"), s["best"].alias("best"), *now)

    def swept(x: Column) -> Column:
        raw, terms, size = x["raw"], x["terms"], x["size"]
        n = F.least(size, F.lit(window))

        def step(s, i):
            left = _once(cell(raw, F.greatest(i - window, F.lit(1))), lambda at: changed(s, at, -1, terms, i > window))
            both = _once(left, lambda t: _once(cell(raw, i), lambda at: changed(t, at, 1, terms, F.lit(True))))
            return _once(both, lambda t: F.struct(t["w"].alias("w"), F.when(i < n, t["best"]).otherwise(F.least(t["best"], t["w"])).alias("best"), *(t[c].alias(c) for c in names)))

        zero = F.struct(F.lit(0.0).alias("w"), F.lit(1e18).alias("best"), *(F.lit(0).cast("long").alias(c) for c in names))
        state = F.aggregate(F.sequence(F.lit(1), size), zero, step)
        return F.log2(n.cast("double")) - state["best"] / n

    return _once(F.struct(run.cast("binary").alias("raw"), term.alias("terms"), F.length(run).alias("size")), swept)


def slug(run: Column) -> Column:
    """Whether the run is a path or slug."""
    pieces = F.split(F.regexp_replace(run, "^/", ""), SLUG_MARK, -1)

    def judged(p: Column) -> Column:
        words = F.slice(p, F.lit(1), F.size(p) - 1)
        return (F.size(p) > 2) & F.element_at(p, -1).rlike(SLUG_LAST) & F.forall(words, lambda w: w.rlike(SLUG_WORD))

    return _once(pieces, judged)


def _entropic(bits: float, window: int):
    def keep(run: Column) -> Column:
        allowed = F.lit(False)
        for p in ALLOWED:
            allowed = allowed | run.rlike(p)
        allowed = allowed | slug(run)
        return F.when(allowed, False).otherwise(F.round(best_entropy(run, window), 6) >= bits)

    return keep


def _found(text: Column, window: int, base64_bits: float, hex_bits: float) -> tuple[Column, Column]:
    """Base spans, and further ones; neither in order."""
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8
    base = F.concat(
        _spans(matches(text, ASSIGN, r"(?i)(?:password|passwd|secret|token|api_?key)[\"' :=]"), 0, value),
        _spans(matches(text, ACCESS, "AKIA[A-Z0-9]{12}"), 1),
        _spans(matches(text, HEX, "[0-9a-f]{32}"), 2),
    )
    # runs with a digit only: the allow-list takes all others anyway
    digit_run = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])"
    more = F.concat(
        _spans(matches(text, digit_run + BASE64_RUN, "[0-9]"), 3, _entropic(base64_bits, window)),
        _spans(matches(text, r"(?<![0-9a-fA-F])" + HEX_RUN, "[0-9a-fA-F]{20}"), 3, _entropic(hex_bits, window)),
    )
    return base, more


def _uncovered(spans: Column) -> Column:
    """Spans in order, without those of kind `entropy` that lie in a base span or stand there twice."""
    base = lambda s: s["kind"] < 3
    again = lambda at, s: (s["start"] == at["start"]) & (s["end"] == at["end"])
    marked = running(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("most"), F.lit(-1).alias("start"), F.lit(-1).alias("end")),
        lambda at, s: F.struct(F.when(base(s), F.greatest(at["most"], s["end"])).otherwise(at["most"]).alias("most"), s["start"].alias("start"), s["end"].alias("end")),
        lambda at, s: F.struct(s["start"].alias("start"), F.when(base(s) | ((s["end"] > at["most"]) & ~again(at, s)), s["kind"]).alias("kind"), s["end"].alias("end")),
        SPAN,
    )
    return F.filter(marked, lambda s: s["kind"].isNotNull())


def scan(docs: DataFrame, text: str = "text", window: int = ENTROPY_WINDOW, base64_bits: float = BASE64_BITS, hex_bits: float = HEX_BITS, base_spans: str = "base_spans", spans: str = "spans") -> DataFrame:
    """docs with two columns more, base_spans and spans: arrays of (start, kind, end); kind is a place in KINDS.

    Columns of docs that have one of these two names are replaced: choose other names to keep them.
    """
    base, more = _found(F.coalesce(F.col(text).cast("string"), F.lit("")), window, base64_bits, hex_bits)
    fresh = f"_{uuid.uuid4().hex}"
    out = docs.withColumns({base_spans: F.array_sort(base), fresh: more})
    return out.withColumn(spans, _uncovered(F.concat(F.col(base_spans), F.col(fresh)))).drop(fresh)


def named(spans: Column) -> Column:
    """kind:start:end, joined by commas in the order of start, then kind."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _part(stretches: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text that is given in stretches."""
    first = F.floor(start / STRETCH).cast("int")
    near = F.array_join(F.slice(stretches, first + 1, F.floor((F.greatest(end, start + 1) - 1) / STRETCH).cast("int") - first + 1), "")
    return F.substring(near, (start - first * STRETCH + 1).cast("int"), (end - start).cast("int"))


def masked(text: Column, spans: Column, mark: str) -> Column:
    """text with each span (in order; overlapping ones together) replaced by mark; linear in the text."""
    # what stands before each span and after the spans before it; null where the span lies in or overlaps an earlier one
    gaps = running(
        spans,
        F.lit(0),
        lambda at, s: F.greatest(at, s["end"]),
        lambda at, s: F.struct(at.alias("start"), F.when(s["start"] >= at, s["start"]).alias("end")),
        "struct<start:int,end:int>",
    )
    last = F.aggregate(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]))
    pieces = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)).alias("stretches"), F.filter(gaps, lambda g: g["end"].isNotNull()).alias("gaps"), last.alias("last"), F.length(text).alias("size"))
    return _once(
        pieces,
        lambda p: F.concat(
            F.array_join(F.transform(p["gaps"], lambda g: F.concat(_part(p["stretches"], g["start"], g["end"]), F.lit(mark))), ""),
            _part(p["stretches"], p["last"], p["size"]),
        ),
    )


def mask(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced by `mark` (overlapping spans by one); n_chars, if there, follows."""
    base, spans, new = (f"_{uuid.uuid4().hex}" for _ in range(3))
    found = scan(docs, text, base_spans=base, spans=spans)
    changed = F.size(spans) > 0
    out = found.withColumn(new, F.when(changed, masked(F.col(text), F.col(spans), mark)).otherwise(F.col(text)))
    size = F.when(changed, F.length(new).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars)) if n_chars in docs.columns else None
    return out.select(*(F.col(new).alias(c) if c == text else size.alias(c) if c == n_chars else F.col(c) for c in docs.columns))
