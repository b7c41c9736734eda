"""Source divergence audit (operator 11): how the words of a language's sources differ.

Tokens come from a translate table: over a text's UTF-8 bytes, `bytes.translate` lowers A-Z and blanks all other
ASCII that is no letter in one pass, `bytes.split` cuts at the blanks, and a `Counter` per document gives each
term's occurrences and, by its keys, the documents that hold it. A task adds these up per (lang, source) and hands
its sums on when it holds `HELD` terms, so what it holds is bounded however many documents it reads.

Everything after that is sparse: only terms that occur in a group are rows. A term that a group lacks has the
group's floor probability, so a sum over all kept terms of a pair of sources (s, t) is put together from
 - the terms of s as if t had none of them, by the distinct counts that occur in s, and the same for t,
 - the terms that neither has, of which only the number matters, and
 - a correction for the terms that both have, by the distinct pairs of counts.
All of it is integer or decimal arithmetic, so results don't depend on the order of rows.

Bounds: the pairs of a language's sources are rows of the result, so their number is taken as given; of a term,
at most one row per source of its language is ever together. Groups are counted before anything is joined to them,
and a group with very many terms is spread (`common.lookup`).

Defined results: null text, lang and source count as ''; a group without terms has the floor probability
for all; a language without kept terms gives value 0 to every pair of its sources and no terms; a source that is alone in its language has no
pairs; ties are ranked by UTF-8 item; repeated rows count each time; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kerbsight.llm.common import lookup, table, workspace
from kerbsight.session import Workspace

SCALE = 1_000_000_000
MIN_DOCS = 10
TOP_TERMS = 10
HELD = 200_000

_KEPT = {*string.ascii_letters.encode(), *range(128, 256)}
TABLE = bytes(x if x in _KEPT else 0x20 for x in range(256)).translate(
    bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
)


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Sums:
    """Occurrences and documents per (lang, source) and term."""

    def __init__(self):
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.held = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        n, d = self.groups.setdefault((lang, source), (Counter(), Counter()))
        before = len(d)
        own = Counter(terms(text))
        d.update(own.keys())
        for term, k in own.items():
            n[term] += k
        self.held += len(d) - before

    def batches(self) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in self.groups.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(n), pa.string()),
                    pa.array([source] * len(n), pa.string()),
                    pa.array(list(n), pa.binary()),
                    pa.array(list(n.values()), pa.int64()),
                    pa.array(list(map(d.__getitem__, n)), pa.int64()),
                ],
                ["lang", "source", "term", "n", "d"],
            )


def count_terms(rows: DataFrame) -> DataFrame:
    """`rows(lang, source, text)` → `(lang, source, term binary, n, d)`, partial sums of the tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lang", "source", "text")]
            for lang, source, text in zip(*columns, strict=True):
                sums.add(lang, source, text)
                if sums.held >= HELD:
                    yield from sums.batches()
                    sums = Sums()
        yield from sums.batches()

    typed = rows.select("lang", "source", F.col("text").cast("binary").alias("text"))
    return typed.mapInArrow(run, "lang string, source string, term binary, n bigint, d bigint")


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)), exactly."""
    whole = lambda c: c.cast("decimal(20,0)")
    of = F.greatest(whole(total) + whole(kept) * 2, F.lit(1).cast("decimal(20,0)"))
    return F.call_function("div", (whole(n) + 2) * F.lit(SCALE).cast("decimal(10,0)"), of) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)² / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


class Audit:
    """The written tables of one audit: `kept` has a row per kept term of a language, `stats` one per
    (lang, source)."""

    def __init__(self, ws: Workspace, rows: DataFrame, min_docs: int = MIN_DOCS):
        found = count_terms(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
        held = found.groupBy("lang", "term").agg(
            F.sum("d").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("per")
        )
        kept = held.where(F.col("docs") >= min_docs).select("lang", "term", "total", F.array_sort("per").alias("per"))
        self.kept = ws.save("kept-terms", kept)
        langs = self.kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all_n"))
        sums = self.present.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("k"))
        groups = rows.select("lang", "source").distinct()
        stats = groups.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0)
        floor = share(F.lit(0), F.col("total"), F.col("v"))
        self.stats = ws.save("groups", stats.withColumn("floor", floor))

    @property
    def present(self) -> DataFrame:
        """`(lang, term, all_count, source, n)` of the terms that a group has."""
        return self.kept.select("lang", "term", F.col("total").alias("all_count"), F.inline("per"))

    def term_ranks(self, top: int) -> DataFrame:
        keyed = F.struct("lang", "source").alias("group")
        left = self.present.select(keyed, "term", "all_count", "n")
        right = self.stats.where("k > 0").select(keyed, "v", "all_n", F.col("total").alias("group_n"), F.col("k").alias("_k"))
        total = self.stats.agg(F.sum("k").alias("n")).first().n or 0
        p, q = share(F.col("n"), F.col("group_n"), F.col("v")), share(F.col("all_count"), F.col("all_n"), F.col("v"))
        scored = lookup(left, right, "group", "_k", total).withColumns({"p": p, "q": q}).where("p > q")
        items = scored.select("group.*", F.col("term").cast("string").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
        return _ranked(items, "term").where(F.col("rank") <= top)

    def pair_ranks(self) -> DataFrame:
        s = self.stats.select("lang", "source", "v", "total", "k", "floor")
        t = s.select("lang", *(F.col(c).alias(f"o_{c}") for c in ("source", "total", "k", "floor")))
        pairs = s.join(t, "lang").where("source != o_source")
        low, high = F.least("source", "o_source").alias("a"), F.greatest("source", "o_source").alias("b")
        f = lambda x, y: apart(x, y)
        floors = f(F.col("floor"), F.col("o_floor"))
        neither = pairs.where("source < o_source").select(
            "lang", low, high, ((F.col("v") - F.col("k") - F.col("o_k")) * floors).alias("value")
        )
        # terms of one source as if the other had none of them, by distinct count
        counts = self.present.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
        p = share(F.col("n"), F.col("total"), F.col("v"))
        one = counts.join(pairs, ["lang", "source"]).select(
            "lang", low, high, (F.col("m") * f(p, F.col("o_floor"))).alias("value")
        )
        # terms of both: what `one` has counted twice, put right
        each = self.kept.select("lang", "per", F.posexplode("per").alias("at", "x"))
        both = each.select("lang", "x", F.explode(F.slice("per", F.col("at") + 2, F.size("per"))).alias("y"))
        both = both.groupBy(
            "lang", F.col("x.source").alias("source"), F.col("y.source").alias("o_source"),
            F.col("x.n").alias("n"), F.col("y.n").alias("o_n"),
        ).agg(F.count("*").alias("m")).join(pairs, ["lang", "source", "o_source"])
        q = share(F.col("o_n"), F.col("o_total"), F.col("v"))
        right = f(p, q) - f(p, F.col("o_floor")) - f(F.col("floor"), q) + floors
        both = both.select("lang", low, high, (F.col("m") * right).alias("value"))
        sums = neither.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        ends = F.inline(F.array(
            F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
            F.struct(F.col("b").alias("source"), F.col("a").alias("item")),
        ))
        return _ranked(sums.select("lang", ends, "value"), "pair")


def _ranked(items: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return items.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(
    ws: Workspace, docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
    min_docs: int = MIN_DOCS, top: int = TOP_TERMS,
) -> DataFrame:
    """`(lang, source, part, item, value, rank)`: for each source of a language all others by distance, and the
    `top` terms that set it apart from its language."""
    plain = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
    found = Audit(ws, docs.select(plain(lang, "lang"), plain(source, "source"), plain(text, "text")), min_docs)
    return found.pair_ranks().unionByName(found.term_ranks(top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(workspace(spark), table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS item FROM d),
kept AS (SELECT lang, item, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
cnt AS (SELECT lang, source, item, count(*) AS c FROM w SEMI JOIN kept USING (lang, item) GROUP BY ALL),
g AS (
  SELECT lang, source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY ALL) USING (lang, source)),
p AS (
  SELECT g.lang, g.source, k.item, coalesce(cnt.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(cnt.c, 0) + 2)) // (g.n + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.c + 2)) // (l.n + 2 * l.v) AS q
  FROM g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN cnt USING (lang, source, item)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b USING (lang, item) WHERE a.source != b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', item, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 10
"""
