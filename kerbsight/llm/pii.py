"""Personal data by patterns and information-theoretic sanitisation (operator 3), with DataFrame
expressions only.

Protected entities are the values of the base kinds: e-mail address, IP address, card number, phone
number. A term (a word of three or more letters) anywhere in a document that holds an entity may give
the entity away. How strongly is estimated from the corpus (after Sanchez and Batet's C-sanitised): with
n(e) documents of N that hold entity e, n(t) that hold term t, and n(t, e) that hold both,

    PMI(t, e) = log2(N n(t, e) / (n(t) n(e))),   IC(e) = log2(N / n(e)),   disclosure = PMI / IC.

Disclosure is 1 when the term occurs in no document without the entity, and falls with every document
that does. From `REMOVE` on the term is removed, from `GENERALISE` on it is generalised, at every place
in the documents that hold the entity. A pair must be seen in at least `SUPPORT` documents: one
observation says nothing.

Counts cover whole documents, and all of them. A pair with fewer than `SUPPORT` documents, or whose term is in
more than n(e)^`GENERALISE` N^(1 - `GENERALISE`), can't disclose enough, since n(t, e) is at most n(e): so entities of
one document and terms that are too frequent for all entities beside them go before any pair is made. Entities, terms and
pairs that very many documents hold meet their counts by `common.lookup`.

Defined results: a null or empty text has no spans; null ids and repeated rows are kept as they are; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kerbsight.llm.common import lookup, table, workspace
from kerbsight.llm.spans import SPAN, replaced, with_spans, written
from kerbsight.session import Workspace

# The base kinds. Where a run can't match from its first character it can't from a
# later one, so a match starts at a run's first character or where the last match ended.
EMAIL = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)"
    r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_VALID = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
CARD = r"(?=(?:[0-9][ -]?){15}[0-9])[0-9]++(?:[ -][0-9]++)*+"
CARD_DIGITS = (16, 19)
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PHONE_DIGITS = (8, 15)
KINDS = ("email", "ip", "card", "phone")
EXTRA = ("generalised", "removed")

SUPPORT = 2
GENERALISE = 0.75
REMOVE = 0.9

#: a word that is no part of an address or a longer token
TERM = r"(?<![\p{L}\p{N}@._%+-])\p{L}{3,}+(?![\p{N}@_%+-]|\.[\p{L}\p{N}])"
WORD = r"[^\p{L}]+"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of `x` pass the Luhn check: from the right, every second digit doubled."""
    d = F.reverse(digits(x))
    code = F.transform(
        F.sequence(F.lit(1), F.length(d)),
        lambda i: F.substring(d, i, F.lit(1)).cast("int") * (2 - i % 2),
    )
    total = F.aggregate(code, F.lit(0), lambda s, v: s + v - F.when(v > 9, 9).otherwise(0))
    return total % 10 == 0


def with_base_spans(df: DataFrame, text: str) -> DataFrame:
    """`df` with the spans of each base kind in `_email` to `_phone`."""
    for kind, regex in zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True):
        df = with_spans(df, text, regex, f"_{kind}")
    return df


def valid(kind: str, x: Column) -> Column:
    n = F.length(digits(x))
    if kind == "ip":
        return F.rlike(x, F.lit(IP_VALID))
    if kind == "card":
        return n.between(*CARD_DIGITS) & luhn(x)
    if kind == "phone":
        return n.between(*PHONE_DIGITS)
    return F.lit(True)


def find_base(df: DataFrame, keep: list[str], text: str = "_text") -> DataFrame:
    """The columns `keep`, the valid spans of each kind, the distinct `entities` (kind and value), and, of texts
    that hold any, all `words`: term, start and end."""
    df = with_base_spans(df, text)

    def spans(kind: str) -> Column:
        return F.filter(f"_{kind}", lambda x: valid(kind, x["value"])).cast(SPAN).alias(kind)

    def entities(kind: str) -> Column:
        return F.transform(kind, lambda x: F.concat(F.lit(f"{kind}:"), F.lower(x["value"])))

    df = df.select(*keep, text, *map(spans, KINDS))
    df = df.withColumn("entities", F.array_distinct(F.concat(*map(entities, KINDS))))
    df = df.withColumn("_own", F.when(F.size("entities") > 0, F.col(text)).otherwise(""))
    words = F.transform(
        "_words",
        lambda x: F.struct(
            F.lower(x["value"]).alias("term"), x["start"].alias("start"), x["end"].alias("end")
        ),
    )
    return with_spans(df, "_own", TERM, "_words").select(*keep, *KINDS, "entities", words.alias("words"))


def most(n_e: Column, n: int) -> Column:
    """The number of documents beyond which a term can't disclose an entity of `n_e` documents enough (and a
    little, as logarithms are rounded)."""
    return F.pow(n_e, F.lit(GENERALISE)) * (n ** (1 - GENERALISE) * (1 + 1e-6))


def holders(ws: Workspace, base: DataFrame, n: int) -> DataFrame:
    """`(_row, entity, n_e)` of the entities that at least `SUPPORT` documents hold, but not all."""
    held = ws.save("held", base.select("_row", F.explode("entities").alias("entity")))
    counted = held.groupBy("entity").agg(F.count("*").alias("n_e"))
    counted = counted.where((F.col("n_e") >= SUPPORT) & (F.col("n_e") < n)).withColumn("n", F.col("n_e"))
    counted = ws.save("entities", counted)
    found = lookup(held, counted, "entity", "n", held.count())
    return ws.save("holders", found.where("n_e IS NOT NULL"))


def term_counts(ws: Workspace, texts: DataFrame) -> DataFrame:
    """`(term, n_t)`: of how many `texts(_text)` have it, for those of at least `SUPPORT`."""
    words = F.array_distinct(F.split(F.lower("_text"), WORD, -1))
    counted = (
        texts.select(F.explode(words).alias("term"))
        .where(F.length("term") >= 3)
        .groupBy("term")
        .agg(F.count("*").alias("n_t"))
    )
    return ws.save("term-counts", counted.where(F.col("n_t") >= SUPPORT))


def candidates(ws: Workspace, base: DataFrame, held: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """`(_row, entity, n_e, term, n_t)` for all terms in the documents of an entity that may disclose it."""
    rows = held.groupBy("_row").agg(F.max("n_e").alias("most_e"))
    words = F.array_distinct(F.transform("words", lambda x: x["term"]))
    terms = base.where(F.size("entities") > 0).select("_row", words.alias("terms")).join(rows, "_row")
    terms = ws.save("terms", terms.select("_row", "most_e", F.explode("terms").alias("term")))
    # n_t is at least the number of rows here
    total = counts.agg(F.sum("n_t").alias("n")).first().n or 0
    known = lookup(terms, counts.withColumn("n", F.col("n_t")), "term", "n", total)
    known = ws.save("rare-terms", known.where(F.col("n_t") <= most(F.col("most_e"), n)).drop("most_e"))
    pairs = known.join(held, "_row").where(F.col("n_t") <= most(F.col("n_e"), n))
    return ws.save("pairs", pairs.select("_row", "entity", "n_e", "term", "n_t"))


def disclosures(pairs: DataFrame, n: int) -> DataFrame:
    """`(entity, term, n_te, disclosure)` for the pairs that have enough support and disclose enough; `pairs` as from
    `candidates`, `n` the number of documents."""
    ic = F.log2(F.lit(n) / F.col("n_e"))
    pmi = F.log2(F.lit(n) * F.col("n_te") / (F.greatest("n_t", "n_te") * F.col("n_e")))
    return (
        pairs.groupBy("entity", "n_e", "term", "n_t")
        .agg(F.count("*").alias("n_te"))
        .where(F.col("n_te") >= SUPPORT)
        .withColumn("disclosure", F.round(pmi / ic, 9))
        .where(F.col("disclosure") >= GENERALISE)
        .select("entity", "term", "n_te", "disclosure")
    )


def find_personal_data(
    ws: Workspace, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: `_id`, the spans of the base kinds in `email` to `phone`, and the
    disclosing terms' in `terms` (start, end, kind, disclosure), by start."""
    rows = docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"),
    )
    base = find_base(rows, ["_id"]).withColumn("_row", F.monotonically_increasing_id())
    base = ws.save("base", base)
    n = base.count()
    held = holders(ws, base, n)
    pairs = candidates(ws, base, held, term_counts(ws, rows.select("_text")), n)
    found = ws.save("disclosures", disclosures(pairs, n))
    seen = lookup(pairs.select("_row", "entity", "term"), found, ["entity", "term"], "n_te", pairs.count())
    seen = seen.where("disclosure IS NOT NULL").groupBy("_row", "term").agg(F.max("disclosure").alias("disclosure"))
    seen = ws.save("seen", seen)
    places = base.join(seen.select("_row").distinct(), "_row", "left_semi").select("_row", F.explode("words").alias("w"))
    spans = (
        places.select("_row", "w.*")
        .join(seen, ["_row", "term"])
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosure"))).alias("t"))
    )
    kind = lambda x: F.when(x["disclosure"] >= REMOVE, EXTRA[1]).otherwise(EXTRA[0])
    terms = F.transform(
        "t",
        lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), kind(x).alias("kind"),
            x["disclosure"].alias("disclosure"),
        ),
    )
    none = F.array().cast("array<struct<start:int,end:int,kind:string,disclosure:double>>")
    joined = base.drop("entities", "words").join(spans, "_row", "left")
    return joined.withColumn("terms", F.coalesce(terms, none)).drop("_row", "t")


def _marked(spans: Column | str, kind: str) -> Column:
    return F.transform(
        spans,
        lambda x: F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")
        ),
    )


def _base() -> Column:
    return F.concat(*(_marked(k, k) for k in KINDS))


def _terms() -> Column:
    """By kind as listed, then start."""

    def of(kind: str) -> Column:
        return _marked(F.filter("terms", lambda x: x["kind"] == kind), kind)

    return F.concat(*map(of, EXTRA))


def sanitised(text: Column) -> Column:
    """The text with entities replaced by their kind, generalised terms by ``[word]``, and removed
    terms left out; for rows of `find_personal_data` joined to their text."""
    marks = F.transform(
        F.concat(_base(), _terms()),
        lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"),
            F.when(x["kind"] == EXTRA[1], "").when(x["kind"] == EXTRA[0], "[word]")
            .otherwise(F.concat(F.lit("["), x["kind"], F.lit("]"))).alias("mask"),
        ),
    )
    return replaced(text, F.array_sort(marks))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(workspace(spark), table(spark, sf_dir, "documents"))
    return found.select(
        F.col("_id").alias("doc_id"),
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS),
        F.sha2(written(_base()), 256).alias("base_sha256"),
        written(F.concat(_base(), _terms())).alias("spans"),
        F.size("terms").cast("bigint").alias("n_terms"),
    )
