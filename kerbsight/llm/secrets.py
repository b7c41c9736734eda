"""Secret scan by patterns and sliding-window entropy (operator 7), with DataFrame expressions only.

Patterns (assign, access, hex) find what is written like a secret. The entropy scan finds the rest:
for each character class (hexadecimal digits, base64 characters without padding) a window of 20 characters slides
over every run of the class that has a digit, and its Shannon entropy is kept up to date by the counts
of the character that enters and the one that leaves. The span reaches from the first to the
last window above the class's threshold. The allow-list leaves out runs of a harmless shape (UUIDs, dates, joined
words) and spans with a placeholder word in them; a word beside the span, as in `sample_key=...`, does not.
Spans that overlap a pattern's are left out too.

The cost is linear in the text: a run is taken in slices that begin with the last 19 characters of the one
before, the counts are a string of 80 characters of which a step replaces two, and what a task holds
beside the text is bounded by a slice.

Thresholds lie about two standard deviations below the mean entropy of a window of uniformly random characters (base64 4.03
bits, hexadecimal 3.49), so that of random strings of 20, 24 and 32 base64 characters about 95 in 100, or more, are found,
given a digit (which 3 % of those of 20 characters lack).

Sums of c log2 c are integers (in units of 2^-20), so that the incremental and the direct
computation agree.

Defined results: a null or empty text has no spans; null ids and repeated rows are kept as they are; an
empty table gives no rows. Other columns of the input are kept and must not begin with an underscore.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kerbsight.llm.common import rows_of, table
from kerbsight.llm.spans import SPAN, replaced, with_spans, written

# The patterns of the base kinds and their least lengths
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
)
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
SLICE = 4096
UNIT = 1 << 20


@dataclass(frozen=True)
class CharClass:
    name: str
    letters: str  # the class without digits, as in a bracket expression
    bits: float  # least entropy of a window

    @property
    def runs(self) -> str:
        """A run of a window or more, which begins where no such character stands before, with a digit."""
        x = self.letters
        return f"(?<![0-9{x}])(?=[{x}]*+[0-9])[0-9{x}]{{{WINDOW},}}+"


CLASSES = (
    CharClass("hex", "a-fA-F", 3.0),
    CharClass("base64", "A-Za-z+/_-", 3.7),
)

#: Runs that look random but aren't secret: UUIDs, dates and times, digits only, and paths or joined
#: words without mixed letters and digits in a part. Possessive, so that long runs don't recurse.
ALLOWED_RUNS = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9_/+-]++$",
    r"^[+/_-]*+(?:[A-Za-z]++|[0-9]++)(?:[+/_-]++(?:[A-Za-z]++|[0-9]++))++[+/_-]*+$",
)
#: Spans of counting sequences and placeholders
ALLOWED_SPANS = (
    r"(?i)0123456789|12345678|abcdefgh|example|sample|placeholder|xxxxx|dummy|changeme",
)


def _weight(c: int) -> int:
    return round(c * math.log2(c) * UNIT) if c else 0


def limit(bits: float) -> int:
    """The largest sum of c log2 c at which a window's entropy is at least `bits`."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * UNIT)


_BEFORE = ord("+") - 1  # the alphabets lie between + and z
_SLOTS = ord("z") - _BEFORE
_ZERO = 48  # a count is the character with this code more
_WEIGHTS = "array(" + ", ".join(f"{_weight(c)}L" for c in range(WINDOW + 1)) + ")"


def _bound(value: str, name: str, body: str) -> str:
    """SQL: `body` with `name` bound to `value`, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _slice_hull(text: str, most: int) -> str:
    """SQL: `first` and `last`, the first start and last end of the windows of `text` whose sum is at
    most `most`, or -1. Characters enter one by one; from the 21st on one leaves."""
    code = lambda i: f"ascii(chars[{i}]) - {_BEFORE}"
    count = lambda slot: f"ascii(substring(s.n, {slot}, 1)) - {_ZERO}"
    enters = f"overlay(s.n PLACING chr({_ZERO} + k.new + 1) FROM c.new FOR 1)"
    leaves = f"overlay({enters} PLACING chr({_ZERO} + k.old - 1) FROM c.old FOR 1)"
    w = lambda c: f"{_WEIGHTS}[{c}]"
    more = f"{w('k.new + 1')} - {w('k.new')}"
    less = f"{w('k.old - 1')} - {w('k.old')}"
    # a character that leaves as the same one enters changes nothing
    next_n = f"CASE WHEN c.new = c.old THEN s.n WHEN c.old = 0 THEN {enters} ELSE {leaves} END"
    total = f"s.sum + CASE WHEN c.new = c.old THEN 0L WHEN c.old = 0 THEN {more} ELSE {more} + {less} END"
    hot = f"c.i >= {WINDOW} AND t.sum <= {most}L"
    result = f"""named_struct('n', t.n, 'sum', t.sum,
        'first', CASE WHEN s.first < 0 AND {hot} THEN c.i - {WINDOW} ELSE s.first END,
        'last', CASE WHEN {hot} THEN c.i ELSE s.last END)"""
    changed = _bound(f"named_struct('n', {next_n}, 'sum', {total})", "t", result)
    counts = f"named_struct('new', {count('c.new')}, 'old', CASE WHEN c.old > 0 THEN {count('c.old')} ELSE 0 END)"
    gone = f"CASE WHEN i > {WINDOW} THEN {code(f'i - {WINDOW + 1}')} ELSE 0 END"
    steps = f"transform(sequence(1, size(chars)), i -> named_struct('i', i, 'new', {code('i - 1')}, 'old', {gone}))"
    return _bound(
        f"split({text}, '')",
        "chars",
        f"""aggregate({steps},
          named_struct('n', repeat(chr({_ZERO}), {_SLOTS}), 'sum', 0L, 'first', -1, 'last', -1),
          (s, c) -> {_bound(counts, "k", changed)},
          s -> named_struct('first', s.first, 'last', s.last))""",
    )


def window_hull(run: str, most: int) -> str:
    """SQL: the hull of the windows of `run`, counted from the run's start, or -1 and -1. The run is
    read in slices, each with the characters that a window before it may still need."""
    joined = f"""named_struct(
        'tail', substring(x, -{WINDOW - 1}, {WINDOW - 1}),
        'at', r.at + char_length(x) - least({WINDOW - 1}, char_length(x)),
        'first', CASE WHEN r.first < 0 AND h.first >= 0 THEN r.at + h.first ELSE r.first END,
        'last', CASE WHEN h.last >= 0 THEN r.at + h.last ELSE r.last END)"""
    step = _bound("concat(r.tail, part)", "x", _bound(_slice_hull("x", most), "h", joined))
    return f"""aggregate(regexp_extract_all({run}, '.{{1,{SLICE}}}', 0),
      named_struct('tail', '', 'at', 0, 'first', -1, 'last', -1), (r, part) -> {step},
      r -> named_struct('first', r.first, 'last', r.last))"""


def _any(patterns, value: Column) -> Column:
    return F.exists(F.array(*map(F.lit, patterns)), lambda a: F.rlike(value, a))


def with_entropy_spans(df: DataFrame, text: str, name: str, classes=CLASSES) -> DataFrame:
    """`df` with the entropy spans of `text`, from all classes, by start."""
    found = []
    for c in classes:
        runs, hulls = f"_runs_{c.name}", f"_hulls_{c.name}"
        df = with_spans(df, text, c.runs, runs)
        df = df.withColumn(runs, F.filter(runs, lambda x: ~_any(ALLOWED_RUNS, x["value"])))
        hull = f"transform({runs}, x -> named_struct('run', x, 'hull', {window_hull('x.value', limit(c.bits))}))"
        df = df.withColumn(hulls, F.expr(f"filter({hull}, h -> h.hull.first >= 0)"))
        spans = F.expr(
            f"transform({hulls}, h -> named_struct('start', h.run.start + h.hull.first, 'end', h.run.start + h.hull.last, "
            "'value', substring(h.run.value, h.hull.first + 1, h.hull.last - h.hull.first)))"
        ).cast(SPAN)
        df = df.withColumn(hulls, F.filter(spans, lambda x: ~_any(ALLOWED_SPANS, x["value"]))).drop(runs)
        found.append(hulls)
    return df.withColumn(name, F.array_sort(F.array_distinct(F.concat(*found)))).drop(*found)


def scan_secrets(df: DataFrame, text: str = "_text") -> DataFrame:
    """`df` with `n_assign`, `n_access`, `n_hex`, `n_entropy`, and the spans: `base` and `spans`,
    arrays of (start, order, kind, end, value) by start and then kind."""
    df = with_spans(df, text, ASSIGN, "_assign")
    value = lambda x: F.regexp_extract(x["value"], ASSIGN, 2)
    df = df.withColumn("_assign", F.filter("_assign", lambda x: F.length(value(x)) >= ASSIGN_VALUE))
    df = with_spans(df, text, ACCESS, "_access")
    df = with_spans(df, text, HEX, "_hex")
    df = with_entropy_spans(df, text, "_entropy")

    def kind(k: int) -> Column:
        return F.transform(
            f"_{KINDS[k]}",
            lambda x: F.struct(
                x["start"].alias("start"), F.lit(k).alias("order"), F.lit(KINDS[k]).alias("kind"),
                x["end"].alias("end"), x["value"].alias("value"),
            ),
        )

    df = df.withColumn("base", F.array_sort(F.concat(kind(0), kind(1), kind(2))))
    beside = F.filter(
        kind(3),
        lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])),
    )
    df = df.withColumn("_extra", beside)
    df = df.withColumn("spans", F.array_sort(F.concat("base", "_extra")))
    counts = {f"n_{k}": F.size(f"_{k}").cast("bigint") for k in KINDS[:3]}
    df = df.withColumns(counts | {"n_entropy": F.size("_extra").cast("bigint")})
    return df.drop(*(f"_{k}" for k in KINDS), "_extra")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets."""
    marks = F.transform(
        spans,
        lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"),
            F.concat(F.lit("["), x["kind"], F.lit("]")).alias("mask"),
        ),
    )
    return replaced(text, marks)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(rows_of(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.select(
        F.col("_id").alias("doc_id"),
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        "n_entropy",
    )


def _sql() -> str:
    """The same in SQL: matches and what lies between them are unnested, running sums of their
    lengths are the places; entropy sums are counted anew for every window."""

    def places(name: str, source: str, key: str, text: str, regex: str) -> str:
        quoted = regex.replace("'", "''")
        return f"""
{name} AS (
  SELECT {key}, m[i] AS value, CAST(sum(length(p[i]) + length(m[i])) OVER w - length(m[i]) AS BIGINT) AS pos
  FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM (
    SELECT {key}, regexp_extract_all({text}, '{quoted}') AS m, string_split_regex({text}, '{quoted}') AS p
    FROM {source}))
  WINDOW w AS (PARTITION BY {key} ORDER BY i))"""

    assign = ASSIGN.replace("*+", "*").replace("++", "+")
    value = assign.replace("'", "''")
    kinds = [
        ("assign", f"length(regexp_extract(value, '{value}', 2)) >= {ASSIGN_VALUE}"),
        ("access", "true"),
        ("hex", "true"),
    ]
    base = " UNION ALL ".join(
        f"SELECT doc_id, pos, {k} AS o, '{name}' AS kind, pos + length(value) AS stop FROM {name}s WHERE {ok}"
        for k, (name, ok) in enumerate(kinds)
    )
    plain = lambda regex: regex.replace("*+", "*").replace("++", "+")
    any_of = lambda patterns, x: " OR ".join(f"regexp_matches({x}, '{plain(a)}')" for a in patterns)
    parts = [
        "docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
        places("assigns", "docs", "doc_id", "text", assign).strip(),
        places("accesss", "docs", "doc_id", "text", "AKIA[A-Z0-9]{14,}").strip(),
        places("hexs", "docs", "doc_id", "text", "[0-9a-f]{16,}").strip(),
        f"base AS ({base})",
    ]
    hot = []
    for c in CLASSES:
        parts.append(places(f"{c.name}_found", "docs", "doc_id", "text", f"[0-9{c.letters}]{{{WINDOW},}}").strip())
        parts.append(
            f"""{c.name}_runs AS (
  SELECT *, row_number() OVER () AS rid FROM {c.name}_found
  WHERE regexp_matches(value, '[0-9]') AND NOT ({any_of(ALLOWED_RUNS, "value")})),
{c.name}_windows AS (
  SELECT rid, value, unnest(generate_series(0, length(value) - {WINDOW})) AS k FROM {c.name}_runs),
{c.name}_sums AS (
  SELECT rid, k, CAST(sum(round(n * log2(n) * {UNIT})) AS BIGINT) AS s
  FROM (SELECT rid, k, ch, count(*) AS n
        FROM (SELECT rid, k, unnest(string_split(substr(value, k + 1, {WINDOW}), '')) AS ch FROM {c.name}_windows)
        GROUP BY ALL) GROUP BY ALL),
{c.name}_hot AS (
  SELECT doc_id, pos + low AS pos, pos + high + {WINDOW} AS stop
  FROM {c.name}_runs JOIN (SELECT rid, min(k) AS low, max(k) AS high FROM {c.name}_sums
                           WHERE s <= {limit(c.bits)} GROUP BY rid) USING (rid)
  WHERE NOT ({any_of(ALLOWED_SPANS, f"substr(value, low + 1, high - low + {WINDOW})")}))"""
        )
        hot.append(f"SELECT * FROM {c.name}_hot")
    parts.append(
        f"""extra AS (
  SELECT DISTINCT h.doc_id, h.pos, 3 AS o, 'entropy' AS kind, h.stop FROM ({" UNION ".join(hot)}) h
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = h.doc_id AND b.pos < h.stop AND h.pos < b.stop))"""
    )
    spelled = "string_agg(kind || ':' || pos || ':' || stop, ',' ORDER BY pos, o, kind, stop)"
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM docs d LEFT JOIN (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(*) FILTER (WHERE kind = 'entropy') AS n_entropy,
         string_agg(kind || ':' || pos || ':' || stop, ',' ORDER BY pos, o) FILTER (WHERE o < 3) AS base_spans,
         {spelled} AS spans
  FROM (SELECT * FROM base UNION ALL SELECT * FROM extra) GROUP BY doc_id) s ON s.doc_id = d.doc_id"""
    )


OP7_SQL = _sql()
