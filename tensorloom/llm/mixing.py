"""Mixing sources to target weights by hierarchical budgeting.

The documents form a tree of domains, languages and sources. A token budget is handed down level by level: the children of a node share its budget by
weight, none above what it can supply (its tokens times the allowed epochs), and what one falls short of goes to its siblings by weight before
anything is left for the level above. Each leaf then takes the prefix of its budget from seeded epochs: every epoch puts the leaf's documents in
the order of a hash of seed, epoch and id, whole epochs come first, and the last one ends with the last document that still fits.

A leaf's prefix is found without ordering the leaf in one task: sums per leaf and leading hash digits tell the range in which the prefix ends, only
that range is ordered, and the prefix becomes a largest hash per leaf. The text itself is not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import materialize

SEED = 20240601
MAX_EPOCHS = 2
BUCKET_DIGITS = 3
MOST_LEAVES = 100_000
DOMAIN_WEIGHTS = {"web": 5, "forum": 2, "books": 2, "reference": 3}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}
DEFAULT_WEIGHT = 1
LEAF = ["domain", "lang", "source"]


def default_domain(source: Column) -> Column:
    """The domain of a source named by a number: five sources a domain, others "other"."""
    number = F.regexp_extract(source, "^src([0-9]{1,9})$", 1)
    names = F.array(*(F.lit(x) for x in DOMAIN_WEIGHTS))
    at = F.when(number == "", F.lit(None)).otherwise(F.floor(number.cast("long") / 5)).cast("int")
    return F.coalesce(F.get(names, at), F.lit("other"))


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def _weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def _share_out(nodes: DataFrame, parents: list[str], child: str) -> DataFrame:
    """nodes(parents.., child, weight, cap, budget of the parent) -> the same with `budget` the child's own.

    By rising cap / weight, a child is filled to its cap as long as the rest of the budget by weight covers it; the others share what is left."""
    ratio = F.col("cap") / F.col("weight")
    w = Window.partitionBy(*parents).orderBy(ratio, child)
    big = "decimal(38,0)"
    before = F.coalesce(F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing))
    full = F.col("cap").cast(big) * onward.cast("decimal(18,0)") <= F.col("weight").cast("decimal(18,0)") * (F.col("budget") - before).cast("decimal(19,0)")
    all_of = Window.partitionBy(*parents)
    marked = nodes.withColumn("full", full)
    rest = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(all_of)
    weights = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(all_of)
    marked = marked.withColumn("rest", rest).withColumn("open", weights)
    part = F.expr("(cast(weight as decimal(18,0)) * cast(rest as decimal(19,0))) div greatest(open, 1)")
    return marked.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(part).cast("long")).drop("full", "rest", "open")


def budgets(
    leaves: DataFrame, budget: int | None = None, epochs: int = MAX_EPOCHS, domain_weights: dict[str, int] = DOMAIN_WEIGHTS, lang_weights: dict[str, int] = LANG_WEIGHTS
) -> DataFrame:
    """leaves(domain, lang, source, tokens) with each leaf's `budget` in tokens. Without a budget, all tokens of the leaves. Names without a weight have
    DEFAULT_WEIGHT. Shares are whole tokens, rounded down, so a node may fall short of its budget by less than its number of children."""
    tree = leaves.withColumn("cap", F.col("tokens") * epochs)
    whole = F.sum("tokens").over(Window.partitionBy()) if budget is None else F.lit(budget)
    domains = tree.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    domains = domains.withColumn("budget", whole.cast("long")).withColumn("weight", _weight("domain", domain_weights)).withColumn("root", F.lit(0))
    domains = _share_out(domains, ["root"], "domain").select("domain", "budget")
    langs = tree.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains, "domain").withColumn("weight", _weight("lang", lang_weights))
    langs = _share_out(langs, ["domain"], "lang").select("domain", "lang", "budget")
    sources = tree.join(langs, ["domain", "lang"]).withColumn("weight", F.lit(DEFAULT_WEIGHT).cast("long"))
    return _share_out(sources, ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", "budget")


def _key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _slim(docs: DataFrame, domain: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, domain, lang, source, tokens) and the columns of `docs` as the struct `row`."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select(
        "doc_id", domain(source).alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), source.alias("source"),
        token_count(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tokens"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"),
    )


def _decide(slim: DataFrame, budget: int | None, epochs: int, seed: int, domain_weights: dict[str, int], lang_weights: dict[str, int]) -> DataFrame:
    """(domain, lang, source, whole, last) for slim(doc_id, domain, lang, source, tokens), a written table: the whole epochs of each leaf, and the largest key of the prefix of
    the epoch behind them."""
    plan = budgets(slim.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens")), budget, epochs, domain_weights, lang_weights).withColumnRenamed("tokens", "all")
    whole = F.when(F.col("all") == 0, F.lit(1)).otherwise(F.expr("budget div greatest(all, 1)")).cast("int")
    plan = materialize(plan.withColumn("whole", whole).withColumn("left_over", F.col("budget") - F.col("whole") * F.col("all")), "budgets")
    near = _near(plan)
    keyed = slim.join(near(plan), LEAF).withColumn("key", _key(seed, F.col("whole"))).withColumn("bucket", F.left("key", F.lit(BUCKET_DIGITS)))
    sums = keyed.groupBy(*LEAF, "left_over", "bucket").agg(F.sum("tokens").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    edge = sums.withColumn("upto", ahead).where("upto > left_over")
    first = F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before")))
    edge = edge.groupBy(*LEAF).agg(first["bucket"].alias("bucket"), first["before"].alias("before"))
    inside = keyed.join(near(edge), [*LEAF, "bucket"])
    so_far = F.sum("tokens").over(Window.partitionBy(*LEAF, "bucket").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ends = inside.withColumn("upto", F.col("before") + so_far).groupBy(*LEAF, "bucket").agg(F.max(F.when(F.col("upto") <= F.col("left_over"), F.col("key"))).alias("last"))
    return materialize(plan.join(ends.select(*LEAF, F.coalesce("last", "bucket").alias("last")), LEAF, "left").select(*LEAF, "whole", "last"), "decided")


def _near(leaves: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What sends a table of leaves to all tasks where there are at most MOST_LEAVES."""
    return F.broadcast if leaves.count() <= MOST_LEAVES else lambda df: df


def _taken(slim: DataFrame, decided: DataFrame, epochs: int, seed: int) -> DataFrame:
    """The rows of `slim` that the mixture takes, once an epoch, with `epoch`."""
    in_prefix = (F.col("whole") < epochs) & F.coalesce(_key(seed, F.col("whole")) <= F.col("last"), F.lit(False))
    times = F.col("whole") + F.when(in_prefix, 1).otherwise(0)
    taken = slim.join(_near(decided)(decided), LEAF).withColumn("times", times).where("times > 0")
    return taken.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))


def mix(
    docs: DataFrame, budget: int | None = None, epochs: int = MAX_EPOCHS, seed: int = SEED,
    domain: Callable[[Column], Column] = default_domain, domain_weights: dict[str, int] = DOMAIN_WEIGHTS, lang_weights: dict[str, int] = LANG_WEIGHTS,
) -> DataFrame:
    """The rows of `docs` that the mixture takes, with their columns and `_domain`, `_epoch` and `_tokens`; a row taken in two epochs comes twice.

    `domain` gives the domain of a source. Tokens are words between white space; they are counted once for the plan, whose steps read the counts only, and once for
    the rows taken. Up to MOST_LEAVES leaves, by their count, go to all tasks, so the documents of a hot leaf stay where they are; more are joined by a shuffle.

    A null text has no tokens; a null language or source is the empty name; rows that repeat an id go together; a leaf without tokens takes all or
    none of its rows with the budget zero: whole epochs. An empty table gives no rows. Columns keep their values whatever their names, as they go as one
    struct; only columns of `docs` named like those three are replaced.
    """
    slim = _slim(docs, domain)
    decided = _decide(materialize(slim.drop("row"), "token_counts"), budget, epochs, seed, domain_weights, lang_weights)
    taken = _taken(slim, decided, epochs, seed)
    named = ("_domain", "_epoch", "_tokens")
    return taken.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in named), F.col("domain").alias("_domain"), F.col("epoch").alias("_epoch"), F.col("tokens").alias("_tokens"))


def mixture(docs: DataFrame) -> DataFrame:
    """What the mixture takes of the documents, without the texts, which are read once: (doc_id, domain, lang, source, epoch, tokens)."""
    slim = materialize(_slim(docs, default_domain).select("doc_id", *LEAF, "tokens", F.col("row")["lang"].alias("as_lang"), F.col("row")["source"].alias("as_source")), "token_counts")
    decided = _decide(slim.drop("as_lang", "as_source"), None, MAX_EPOCHS, SEED, DOMAIN_WEIGHTS, LANG_WEIGHTS)
    taken = _taken(slim, decided, MAX_EPOCHS, SEED)
    return taken.select("doc_id", "domain", F.col("as_lang").alias("lang"), F.col("as_source").alias("source"), F.col("epoch").cast("long").alias("epoch"), "tokens")


def _case(column: str, weights: dict[str, int]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in weights.items()) + f" else {DEFAULT_WEIGHT} end"


def _sql_share(table: str, parents: str, child: str) -> str:
    return f"""(select *, case when is_full then cap else (weight::hugeint * (budget - coalesce(sum(case when is_full then cap end) over (partition by {parents}), 0)))
      // greatest(coalesce(sum(case when not is_full then weight end) over (partition by {parents}), 0), 1) end as own
    from (select *, cap::hugeint * sum(weight) over (partition by {parents} order by cap / weight, {child} rows between current row and unbounded following)
        <= weight::hugeint * (budget - coalesce(sum(cap) over (partition by {parents} order by cap / weight, {child} rows between unbounded preceding and 1 preceding), 0)) as is_full
      from {table}))"""


#: The mixture over the table documents in DuckDB's SQL.
MIXTURE_SQL = f"""
with docs as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    case when regexp_full_match(coalesce(source, ''), 'src[0-9]{{1,9}}') then coalesce(([{", ".join(f"'{x}'" for x in DOMAIN_WEIGHTS)}])[substr(source, 4)::bigint // 5 + 1], 'other') else 'other' end as domain,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) as tokens
  from documents),
leaves as (select domain, lang, source, sum(tokens)::bigint as tokens, sum(tokens)::bigint * {MAX_EPOCHS} as cap from docs group by all),
d0 as (select domain, sum(cap)::bigint as cap, {_case("domain", DOMAIN_WEIGHTS)} as weight, (select sum(tokens) from leaves)::bigint as budget, 0 as root from leaves group by domain),
d1 as (select domain, own::bigint as budget from {_sql_share("d0", "root", "domain")}),
l0 as (select domain, lang, sum(cap)::bigint as cap, {_case("lang", LANG_WEIGHTS)} as weight, any_value(budget) as budget from leaves join d1 using (domain) group by domain, lang),
l1 as (select domain, lang, own::bigint as budget from {_sql_share("l0", "domain", "lang")}),
s0 as (select leaves.*, {DEFAULT_WEIGHT} as weight, budget from leaves join l1 using (domain, lang)),
plan as (
  select domain, lang, source, tokens as leaf_tokens, case when tokens = 0 then 1 else own // greatest(tokens, 1) end as whole,
    own - tokens * (case when tokens = 0 then 1 else own // greatest(tokens, 1) end) as remains
  from {_sql_share("s0", "domain, lang", "source")}),
keyed as (
  select docs.*, whole, remains, leaf_tokens, sum(docs.tokens) over (
    partition by domain, lang, source order by md5(concat_ws(':', '{SEED}', whole::varchar, coalesce(doc_id::varchar, '')))) as upto
  from docs join plan using (domain, lang, source)),
timed as (select *, whole + case when whole < {MAX_EPOCHS} and leaf_tokens > 0 and upto <= remains then 1 else 0 end as times from keyed)
select doc_id, domain, lang, source, unnest(range(times::bigint)) as epoch, tokens from timed
"""
