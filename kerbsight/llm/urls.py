"""URL filter by rules and a character language-model ratio (operator 6), with DataFrame expressions
only.

A rule (host, path) fits its host and all subdomains where the URL's path starts with the rule's path;
the longest rule that fits decides. URLs that no rule fits are judged by the method:

1. The URLs that rules accept and reject are the samples of two variable-order Markov models over the
   characters after ``://``. Five-grams are counted over all of them; lower orders are sums of these.
2. Probabilities are smoothed after Witten and Bell: with n of N characters after a context that has T
   different ones, p = (n + T p') / (N + T), p' being the next shorter context's.
3. Models keep every gram of the samples. Every character of a URL is scored by the longest gram that
   the samples hold; what that gives is worked out once per distinct five characters of all URLs.
4. The mean log-ratio of a URL's characters is compared with a threshold calibrated on the samples: where
   normal densities of the two classes' scores, with pooled variance, times the classes' sizes are equal.

No table is bounded by a cap. The scores of grams that make up at least one in `SHARE` of all characters, at most `SHARE`
whatever the input, are broadcast; the characters of other grams, none of which is frequent, meet theirs by a shuffle.

Log-ratios are summed as integers (units of 1e-9), so that the sum's order doesn't matter.

Defined results: a null URL, or one without ``://``, has empty host and path, no rule, and the score 0 of an
empty text; if the samples are of one class only, or not told apart, the larger class is the verdict (allow if
equal); ties of equally long rules go to block; repeated rows and null ids are judged row by row; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kerbsight.llm.common import table, workspace
from kerbsight.session import Workspace

ORDER = 4
#: A gram is frequent when it makes up at least one in SHARE of all characters. Results don't depend on it.
SHARE = 1 << 16
ALPHABET = 256
UNIT = 10**9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BEFORE, AFTER = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, everything after the scheme, A-Z lower-cased); empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, path, F.translate(rest, UPPER, LOWER)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(length, block, name, verdict) of the longest rule that fits, or null. Rules are
    configuration; they are part of the plan."""
    kind = "array<struct<length:int,block:boolean,name:string,verdict:string,host:string,path:string>>"
    known = [
        F.struct(
            F.lit(len(r.name)).alias("length"),
            F.lit(r.verdict == "block").alias("block"),
            F.lit(r.name).alias("name"),
            F.lit(r.verdict).alias("verdict"),
            F.lit(r.host).alias("host"),
            F.lit(r.path).alias("path"),
        )
        for r in rules
    ]
    fits = F.filter(
        F.array(*known).cast(kind),
        lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"])))
        & F.startswith(path, r["path"]),
    )
    return F.when(F.size(fits) > 0, F.array_max(fits))


def grams(text: str) -> Column:
    """The five characters that end at each character of the text and at its end."""
    padded = f"concat(repeat('{BEFORE}', {ORDER}), {text}, '{AFTER}')"
    return F.expr(
        f"transform(sequence(1, char_length({text}) + 1), i -> substring({padded}, i, {ORDER + 1}))"
    )


def train(ws: Workspace, samples: DataFrame) -> list[DataFrame]:
    """`samples(text, label)` → for each order from 0 the table `(gram, ratio)` of the log-ratios of
    accepting over rejecting probability, in units of 1e-9."""
    yes = F.col("label") == "allow"
    counts = (
        samples.select("label", F.explode(grams("text")).alias("gram"))
        .groupBy("gram")
        .agg(F.count_if(yes).alias("a"), F.count_if(~yes).alias("r"))
    )
    orders = [ws.save("grams", counts)]
    for k in range(ORDER - 1, -1, -1):
        shorter = F.substring("gram", F.lit(2), F.lit(k + 1))
        lower = orders[0].groupBy(shorter.alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        orders.insert(0, ws.save("grams", lower))
    found: list[DataFrame] = []
    for k, counts in enumerate(orders):
        context = F.substring("gram", F.lit(1), F.lit(k))
        after = counts.groupBy(context.alias("context")).agg(
            F.sum("a").alias("na"),
            F.sum("r").alias("nr"),
            F.count_if(F.col("a") > 0).alias("ta"),
            F.count_if(F.col("r") > 0).alias("tr"),
        )
        kept = counts.withColumn("context", context).join(after, "context")
        if k:
            prior = found[-1].select(F.col("gram").alias("shorter"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
            kept = kept.withColumn("shorter", F.substring("gram", F.lit(2), F.lit(k))).join(prior, "shorter")
        else:
            kept = kept.withColumns({"qa": F.lit(1.0 / ALPHABET), "qr": F.lit(1.0 / ALPHABET)})

        def smooth(n: str, total: str, kinds: str, lower: str) -> Column:
            c = (F.col(n) + F.col(kinds) * F.col(lower)) / (F.col(total) + F.col(kinds))
            return F.when(F.col(total) > 0, c).otherwise(F.col(lower))

        pa, pr = smooth("a", "na", "ta", "qa"), smooth("r", "nr", "tr", "qr")
        found.append(ws.save("model", kept.select("gram", pa.alias("pa"), pr.alias("pr"))))
    ratio = F.round((F.log("pa") - F.log("pr")) * UNIT).cast("bigint")
    return [m.select("gram", ratio.alias("ratio")) for m in found]


def score(ws: Workspace, rows: DataFrame, model: list[DataFrame]) -> DataFrame:
    """`rows(_row, text)` with unique `_row` → `(_row, score)`, the mean log-ratio of the characters."""
    at = rows.select("_row", F.explode(grams("text")).alias("gram"))
    seen = ws.save("seen", at.groupBy("gram").agg(F.count("*").alias("n")))
    total = seen.agg(F.sum("n").alias("n")).first().n or 0
    # a shorter gram is the end of at most as many longer ones as there are characters: no join has a hot key
    known = None
    for k, ratios in enumerate(model):
        end = F.substring("gram", F.lit(ORDER + 1 - k), F.lit(k + 1))
        ends = seen.select(end.alias("gram")).distinct().join(ratios, "gram", "left")
        if known is None:
            found = ends.select("gram", F.coalesce("ratio", F.lit(0).cast("bigint")).alias("ratio"))
        else:
            lower = known.select(F.col("gram").alias("end"), F.col("ratio").alias("lower"))
            ends = ends.withColumn("end", F.substring("gram", F.lit(2), F.lit(k))).join(lower, "end")
            found = ends.select("gram", F.coalesce("ratio", "lower").alias("ratio"))
        known = ws.save("ratios", found)
    frequent = F.col("n") * SHARE >= F.lit(total)
    hot = known.join(seen.where(frequent).select("gram"), "gram")
    cold = known.join(seen.where(~frequent).select("gram"), "gram")
    at = at.join(F.broadcast(hot), "gram", "left")
    # the frequent grams of a row are summed before the shuffle
    sums = [
        at.where("ratio IS NOT NULL").select("_row", "ratio"),
        at.where("ratio IS NULL").select("_row", "gram").join(cold, "gram").select("_row", "ratio"),
    ]
    parts = [x.groupBy("_row").agg(F.sum("ratio").alias("sum"), F.count("*").alias("n")) for x in sums]
    summed = parts[0].unionByName(parts[1]).groupBy("_row").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
    return summed.select("_row", (F.col("sum") / UNIT / F.col("n")).alias("score"))


def threshold(scored: DataFrame) -> float | None:
    """The score from which a URL is accepted: minus or plus infinity where nothing tells the
    classes apart and the one or the other is larger."""
    of = scored.where("label IS NOT NULL").groupBy("label").agg(
        F.count("*").alias("n"), F.avg("score").alias("mean"), F.var_pop("score").alias("var")
    )
    found = {x.label: x for x in of.collect()}
    a, r = found.get("allow"), found.get("block")
    if a is None or r is None or a.mean <= r.mean:
        return math.inf if r is not None and (a is None or r.n > a.n) else -math.inf
    pooled = (a.n * a.var + r.n * r.var) / (a.n + r.n)
    return (a.mean + r.mean) / 2 + pooled * math.log(r.n / a.n) / (a.mean - r.mean)


def judge_urls(
    ws: Workspace,
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: `(_id, host, path, rule, verdict, score)`."""
    host, path, text = split_url(F.col(f"`{url_col}`").cast("string"))
    rows = pages.select(
        F.col(f"`{id_col}`").alias("_id"), host.alias("host"), path.alias("path"), text.alias("text")
    )
    best = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("_best", best).select(
        "_id", "host", "path", "text",
        F.col("_best.name").alias("rule"), F.col("_best.verdict").alias("label"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = ws.save("urls", rows)
    model = train(ws, rows.where("label IS NOT NULL").select("text", "label"))
    scores = score(ws, rows.select("_row", "text"), model)
    scored = ws.save("scores", rows.drop("text").join(scores, "_row"))
    limit = threshold(scored)
    by_score = F.when(F.col("score") >= F.lit(limit), "allow").otherwise("block")
    return scored.select(
        "_id", "host", "path", "rule", F.coalesce("label", by_score).alias("verdict"), "score"
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge_urls(workspace(spark), table(spark, sf_dir, "pages"))
    return found.select(
        F.col("_id").alias("page_id"), "host", "path", "rule", "verdict",
        F.round("score", 6).alias("score"),
    )


def _sql() -> str:
    """The same in SQL: the counts of each order, its smoothed probabilities, the longest known gram."""
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)
    parts = [
        f"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, translate(rest, '{UPPER}', '{LOWER}') AS text
  FROM cut),
rules(rhost, rpath, rverdict) AS (VALUES {rules}),
fit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(rverdict, length(rhost || rpath)) AS label
  FROM parsed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id),
urls AS (SELECT parsed.*, rule, label FROM parsed LEFT JOIN fit USING (page_id)),
padded AS (SELECT page_id, label, repeat(chr(2), {ORDER}) || text || chr(3) AS s, length(text) + 1 AS n FROM urls),
positions AS (
  SELECT page_id, label, i, substr(s, i, {ORDER + 1}) AS g
  FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM padded)),
c{ORDER} AS (
  SELECT g AS gram, count(*) FILTER (WHERE label = 'allow') AS a, count(*) FILTER (WHERE label = 'block') AS r
  FROM positions WHERE label IS NOT NULL GROUP BY g)"""
    ]
    for k in range(ORDER - 1, -1, -1):
        parts.append(
            f"c{k} AS (SELECT substr(gram, 2, {k + 1}) AS gram, sum(a) AS a, sum(r) AS r FROM c{k + 1} GROUP BY 1)"
        )
    for k in range(ORDER + 1):
        p = "CASE WHEN n{0} > 0 THEN ({0} + t{0} * q{0}) / (n{0} + t{0}) ELSE q{0} END AS p{0}"
        lower = f"JOIN m{k - 1} l ON l.gram = substr(c.gram, 2, {k})" if k else ""
        q = "l.pa AS qa, l.pr AS qr" if k else f"{1 / ALPHABET} AS qa, {1 / ALPHABET} AS qr"
        parts.append(
            f"""m{k} AS (
  SELECT gram, {p.format("a")}, {p.format("r")} FROM (
    SELECT c.gram, c.a::DOUBLE AS a, c.r::DOUBLE AS r, na::DOUBLE AS na, nr::DOUBLE AS nr, ta, tr, {q}
    FROM c{k} c JOIN (SELECT substr(gram, 1, {k}) AS context, sum(a) AS na, sum(r) AS nr,
                      count(*) FILTER (WHERE a > 0) AS ta, count(*) FILTER (WHERE r > 0) AS tr
                      FROM c{k} GROUP BY 1) x ON x.context = substr(c.gram, 1, {k}) {lower}))"""
        )
    ratios = ", ".join(f"round((ln(m{k}.pa) - ln(m{k}.pr)) * {UNIT})" for k in range(ORDER, -1, -1))
    joins = " ".join(
        f"LEFT JOIN m{k} ON m{k}.gram = substr(g, {ORDER + 1 - k}, {k + 1})" for k in range(ORDER + 1)
    )
    parts.append(
        f"""summed AS (
  SELECT page_id, sum(coalesce({ratios}, 0)) / {UNIT} / count(*) AS score FROM positions {joins} GROUP BY page_id),
scored AS (SELECT urls.*, score FROM urls JOIN summed USING (page_id)),
cal AS (
  SELECT count(*) FILTER (WHERE label = 'allow') AS na, count(*) FILTER (WHERE label = 'block') AS nr,
         avg(score) FILTER (WHERE label = 'allow') AS ma, avg(score) FILTER (WHERE label = 'block') AS mr,
         var_pop(score) FILTER (WHERE label = 'allow') AS va, var_pop(score) FILTER (WHERE label = 'block') AS vr
  FROM scored),
lim AS (
  SELECT CASE WHEN na = 0 OR nr = 0 OR ma <= mr
              THEN CASE WHEN nr > na THEN 1e300 ELSE -1e300 END
              ELSE (ma + mr) / 2 + (na * va + nr * vr) / (na + nr) * ln(nr / na) / (ma - mr) END AS t FROM cal)
SELECT page_id, host, path, rule, coalesce(label, CASE WHEN score >= t THEN 'allow' ELSE 'block' END) AS verdict,
       round(score, 6) AS score
FROM scored, lim"""
    )
    return ",\n".join(parts[:-1]) + ",\n" + parts[-1]


OP6_SQL = _sql()
