"""Mixing sources to target weights by temperature, in DataFrame and SQL functions only.

The token share p of every source is raised to an exponent and normalised. The exponent is found by
bisection: the largest in [0, 1] whose weights still have the entropy asked for (``entropy``, as a fraction of the
greatest possible), raised where a source would otherwise be repeated more than ``repeats`` times; the limit on
repetition goes before the entropy. Both conditions are monotonous in the exponent. A source then gets
``floor(budget * weight)`` tokens.

A source is drawn in passes. In every pass a hash of pass and doc_id deals its documents into blocks of about
``BLOCK_TOKENS`` tokens and orders blocks and documents, and documents are taken as long as the tokens before
them are below the source's quota. Running totals are kept within blocks and over the totals of blocks, so a source with
a third of all rows is many small windows. A document comes once in each full pass and at most once in the last.

A token is a word ``[^\\x20\\x09-\\x0D]+``. Nulls: a null source is a source of its own; null or wordless texts have no
tokens and are never drawn; a null doc_id is hashed as the word null. Ties of the hash are ordered by doc_id and
tokens. Repeated rows are drawn each. Other columns are carried along, whatever their names. An empty table gives an
empty result. The list of sources is one row of the plan; documents are not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table

ENTROPY = 0.95
REPEATS = 4.0
BLOCK_TOKENS = 100_000
STEPS = 40
TOKEN = "[^\\x20\\x09-\\x0D]+"


def _bisect(condition: str, keep_low: bool) -> str:
    """The edge in [0, 1] of a ``condition`` on ``{x}``: true up to it (``keep_low``) or from it on."""
    middle = "((b.low + b.high) / 2)"
    true, false = f"named_struct('low', {middle}, 'high', b.high)", f"named_struct('low', b.low, 'high', {middle})"
    if not keep_low:
        true, false = false, true
    step = f"if({condition.format(x=middle)}, {true}, {false})"
    start = "named_struct('low', 0D, 'high', 1D)"
    return f"aggregate(sequence(1, {STEPS}), {start}, (b, i) -> {step}).{'low' if keep_low else 'high'}"


def plan_quotas(tokens: DataFrame, budget: int | None, entropy: float, repeats: float) -> DataFrame:
    """source_key, tokens, weight, quota and blocks of each source; ``tokens`` has source_key and n_tokens.

    ``budget`` None is the number of tokens there are.
    """
    totals = tokens.groupBy("source_key").agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0")
    one = totals.agg(F.sort_array(F.collect_list(F.struct("source_key", "tokens"))).alias("sources"))
    one = one.withColumn("total", F.expr("aggregate(sources, 0L, (a, s) -> a + s.tokens)"))
    one = one.withColumn("budget", F.col("total") if budget is None else F.lit(budget).cast("long"))
    one = one.withColumn("p", F.expr("transform(sources, s -> s.tokens / total)"))
    mass = "aggregate(p, 0D, (a, q) -> a + power(q, {x}))"
    h = f"(ln({mass}) - {{x}} * aggregate(p, 0D, (a, q) -> a + power(q, {{x}}) * ln(q)) / {mass})"
    spread = f"{h} >= {entropy!r}D * ln(size(p))"
    most = f"aggregate(p, 0D, (a, q) -> greatest(a, power(q, {{x}} - 1))) / {mass}"
    sparing = f"(budget / total) * {most} <= {repeats!r}D"
    one = one.withColumn("warmest", F.expr(f"if({spread.format(x='1D')}, 1D, {_bisect(spread, True)})"))
    one = one.withColumn("sparing", F.expr(f"if({sparing.format(x='0D')}, 0D, {_bisect(sparing, False)})"))
    one = one.withColumn("exponent", F.greatest("warmest", "sparing"))
    one = one.withColumn("mass", F.expr(mass.format(x="exponent")))
    weight = F.pow(F.col("s.tokens") / F.col("total"), F.col("exponent")) / F.col("mass")
    return (
        one.select("total", "budget", "exponent", "mass", F.explode("sources").alias("s"))
        .withColumn("weight", weight)
        .select(
            "s.source_key",
            "s.tokens",
            "weight",
            F.floor(F.col("budget") * F.col("weight")).alias("quota"),
            F.ceil(F.col("s.tokens") / BLOCK_TOKENS).alias("blocks"),
        )
    )


def _keyed(documents: DataFrame) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("n"))
    tokens = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(TOKEN)).cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    keyed = documents.select(row.alias("row"), "doc_id", key.alias("source_key"), tokens.alias("n_tokens"))
    return keyed.filter("n_tokens > 0")


_ORDER = "md5(concat(pass_no, ':', coalesce(cast(doc_id as string), 'null')))"


def draw(keyed: DataFrame, quotas: DataFrame) -> DataFrame:
    """doc_id, source_key, pass_no, block_no, n_tokens, tokens_before and order_key of every draw."""
    documents = keyed.groupBy("source_key", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"))
    dealt = (
        documents.join(quotas.filter("quota > 0"), "source_key")
        .withColumn("pass_no", F.expr("explode(sequence(0L, (quota - 1) div tokens))"))
        .withColumn("order_key", F.expr(_ORDER))
        .withColumn(
            "block_no",
            F.shiftright(F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long") * F.col("blocks"), 32),
        )
    )
    place = ["source_key", "pass_no", "block_no"]
    by_block = Window.partitionBy("source_key", "pass_no").orderBy("block_no")
    totals = (
        dealt.groupBy(place)
        .agg(F.sum("n_tokens").alias("of_block"))
        .select(*place, (F.sum("of_block").over(by_block) - F.col("of_block")).alias("before_block"))
    )
    within = Window.partitionBy(place).orderBy("order_key").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("pass_no") * F.col("tokens") + F.col("before_block") + F.col("within") - F.col("n_tokens")
    return (
        dealt.withColumn("within", F.sum("n_tokens").over(within))
        .join(totals, place)
        .withColumn("tokens_before", before)
        .filter("tokens_before < quota")
        .select("doc_id", *place, "n_tokens", "tokens_before", "order_key")
    )


def mixture(
    documents: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS
) -> tuple[DataFrame, DataFrame]:
    """(draws, quotas): one row per document and pass in which it is drawn, and the plan of the sources."""
    keyed = _keyed(documents).drop("row")
    keyed = write_table(keyed, "source-tokens")  # counts the words of each text once
    quotas = write_table(plan_quotas(keyed, budget, entropy, repeats), "quotas")
    return draw(keyed, quotas), quotas


def mix(
    documents: DataFrame, budget: int | None = None, entropy: float = ENTROPY, repeats: float = REPEATS
) -> DataFrame:
    """Rows of ``documents`` (doc_id, text, source, ...), each as often as it is drawn.

    Texts are not shuffled: in the last pass of a source its documents up to one place of the order are drawn.
    """
    draws, quotas = mixture(documents, budget, entropy, repeats)
    last = draws.groupBy("source_key", "pass_no").agg(F.max("order_key").alias("cut"))
    ends = quotas.filter("quota > 0").select("source_key", F.expr("(quota - 1) div tokens").alias("pass_no"))
    ends = write_table(ends.join(last, ["source_key", "pass_no"]).withColumnRenamed("pass_no", "last_pass"), "cuts")
    return (
        _keyed(documents)
        .join(ends, "source_key")
        .withColumn("pass_no", F.expr("explode(sequence(0L, last_pass))"))
        .filter(f"pass_no < last_pass or {_ORDER} <= cut")
        .select("row.*")
    )
