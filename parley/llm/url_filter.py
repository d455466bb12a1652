"""URL filtering by rules and, where none fits, by a character language-model ratio.

Two variable-order Markov models with interpolated Witten-Bell smoothing learn the
characters of accepted and of rejected URLs, here those that an allow or a block rule
decides.  A URL's log-likelihood difference divided by its length is compared with a
cutoff that is calibrated on labelled URLs kept apart.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drawn, stored
from .ranged import ranged, running

#: (verdict, host, path)
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ORDER = 4
#: The calibrated cutoff blocks at most this part of the accepted URLs kept apart.
FALSE_BLOCK = 0.05
#: Likelihood of a character under no context.
FLOOR = 1 / 1024
END = "\n"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """A URL's host, A-Z lower-cased, and its path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_name(rule: Rule) -> str:
    return rule[1] + rule[2]


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict, or nulls; of equally long ones the one with the longer host."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(rule_name(r)), len(r[1]), r)):
        fits = ((host == rule[1]) | host.endswith(f".{rule[1]}")) & path.startswith(rule[2])
        name = F.when(fits, F.lit(rule_name(rule))).otherwise(name)
        verdict = F.when(fits, F.lit(rule[0])).otherwise(verdict)
    return name, verdict


@dataclass
class Markov:
    """Contexts of 0 to ORDER characters: (occurrences, different next characters, counts)."""

    nodes: dict[str, tuple[int, int, dict[str, int]]]

    @classmethod
    def of(cls, grams: list[tuple[str, str, int]]) -> Markov:
        counts: dict[str, dict[str, int]] = defaultdict(dict)
        for context, following, n in grams:
            counts[context][following] = n
        return cls({k: (sum(v.values()), len(v), v) for k, v in counts.items()})

    def log_likelihood(self, text: str) -> float:
        """Of ``text`` and its end."""
        total, nodes = 0.0, self.nodes
        text += END
        for i, char in enumerate(text):
            p = FLOOR
            for k in range(min(i, ORDER) + 1):
                node = nodes.get(text[i - k : i])
                if node is None:
                    break
                n, kinds, following = node
                p = (following.get(char, 0) + kinds * p) / (n + kinds)
            total += math.log(p)
        return total


def difference(accepted: Markov, rejected: Markov, text: str) -> float:
    return (accepted.log_likelihood(text) - rejected.log_likelihood(text)) / (len(text) + 1)


def _spots(addresses: DataFrame, *more: str) -> DataFrame:
    """(address, spot) and ``more`` columns for every character of each address and its end: up to ORDER characters before it, and itself."""
    ended = addresses.select("address", *more, F.concat("address", F.lit(END)).alias("t"))
    places = ended.select("address", *more, "t", F.explode(F.sequence(F.lit(1), F.length("t"))).alias("i"))
    return places.select("address", *more, F.expr(f"substring(t, greatest(1, i - {ORDER}), least(i, {ORDER + 1}))").alias("spot"))


def _grams(spots: DataFrame) -> DataFrame:
    """``spots`` with a row for each ``k`` from 0 to ORDER: the ``k`` characters ``context`` and what follows, ``next``."""
    each = spots.select("*", F.explode(F.sequence(F.lit(0), F.length("spot") - 1)).alias("k"))
    return each.select("*", F.expr("substring(spot, length(spot) - k, k)").alias("context"), F.expr("substring(spot, length(spot), 1)").alias("next"))


def learned(known: DataFrame) -> DataFrame:
    """A stored table (context, next, allow, block) of the counts over all of ``known`` (decided, address)."""
    weighed = _grams(_spots(known, "decided"))
    sums = (F.sum((F.col("decided") == v).cast("long")).alias(v) for v in ("allow", "block"))
    return stored(weighed.groupBy("context", "next").agg(*sums), "url-grams")


def spot_scores(spots: DataFrame, grams: DataFrame) -> DataFrame:
    """(spot, score): how much likelier its last character is for accepted than for rejected URLs, in logs.

    The likelihood depends on the spot alone, so each different one is looked up once.
    """
    nodes = grams.groupBy("context").agg(
        *(F.sum(v).alias(f"{v}_n") for v in ("allow", "block")), *(F.sum((F.col(v) > 0).cast("long")).alias(f"{v}_kinds") for v in ("allow", "block"))
    )
    rows = _grams(spots.select("spot").distinct())
    # every spot has the empty context, so its one row isn't joined by key
    root = nodes.where("context = ''")
    seen = rows.where("k > 0").join(nodes.hint("merge"), "context", "left").unionByName(rows.where("k = 0").drop("context").crossJoin(F.broadcast(root)))
    # n-grams and addresses grow with the pages, so they are always merged, never broadcast
    seen = seen.join(grams.hint("merge"), ["context", "next"], "left")
    counts = F.struct("k", *(F.coalesce(c, F.lit(0)).alias(c) for v in ("allow", "block") for c in (v, f"{v}_n", f"{v}_kinds")))
    listed = seen.groupBy("spot").agg(F.array_sort(F.collect_list(counts)).alias("orders"))

    def likelihood(v: str) -> Column:
        def step(p: Column, at: Column) -> Column:
            n, kinds = at[f"{v}_n"], at[f"{v}_kinds"]
            return F.when(n > 0, (at[v] + kinds * p) / (n + kinds)).otherwise(p)

        return F.aggregate("orders", F.lit(FLOOR), step)

    return listed.select("spot", (F.log(likelihood("allow")) - F.log(likelihood("block"))).alias("score"))


def ratios(addresses: DataFrame, grams: DataFrame) -> DataFrame:
    """A stored table (address, ratio) of the different ``addresses``."""
    spots = stored(_spots(addresses), "url-spots")
    scores = stored(spot_scores(spots, grams), "url-spot-scores")
    # decimals, so that a sum doesn't depend on its order
    summed = spots.join(scores.hint("merge"), "spot").groupBy("address").agg(F.sum(F.col("score").cast("decimal(20,15)")).cast("double").alias("sum"))
    return stored(summed.select("address", (F.col("sum") / (F.length("address") + 1)).alias("ratio")), "url-ratios")


def calibrate(accepted: list[float], rejected: list[float], false_block: float = FALSE_BLOCK) -> float:
    """The cutoff of best balanced accuracy among those that block at most ``false_block`` of ``accepted``.

    It lies halfway between the scores that it parts.
    """
    if not accepted:
        return 0.0
    accepted, rejected = sorted(accepted), sorted(rejected)
    best, cutoff, below = -1.0, accepted[0], 0
    for k, value in enumerate(accepted):
        if k > false_block * len(accepted):
            break
        while below < len(rejected) and rejected[below] < value:
            below += 1
        gain = below / max(1, len(rejected)) - k / len(accepted)
        if gain > best:
            best, cutoff = gain, (value + rejected[below - 1]) / 2 if below else value
    return cutoff


def calibrated(scored: DataFrame, false_block: float = FALSE_BLOCK) -> float:
    """:func:`calibrate` of all rows (decided, ratio) of ``scored``, however many: only the cutoff gets to the driver."""
    each = (F.sum((F.col("decided") == v).cast("long")).alias(v) for v in ("allow", "block"))
    counts = stored(scored.groupBy("ratio").agg(*each), "url-calibration")
    total = counts.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    if not total["allow"]:
        return 0.0
    in_order = ranged(counts.withColumn("all", F.lit(0)), ["all"], ["ratio"], "url-ranges")
    summed = running(in_order, ["all"], {"allows": ("sum", F.col("allow")), "blocks": ("sum", F.col("block"))})
    # what lies below a ratio is the sums up to it without its own
    below = summed.select("ratio", "allow", (F.col("allows") - F.col("allow")).alias("lost"), (F.col("blocks") - F.col("block")).alias("won"))
    open_ones = below.where((F.col("allow") > 0) & (F.col("lost") <= false_block * total["allow"]))
    gain = F.col("won") / max(1, total["block"]) - F.col("lost") / total["allow"]
    at = open_ones.orderBy(gain.desc(), "ratio").first()["ratio"]
    beside = counts.where((F.col("block") > 0) & (F.col("ratio") < at)).agg(F.max("ratio").alias("ratio")).first()["ratio"]
    return at if beside is None else (at + beside) / 2


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int | None = None) -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict, ratio.

    ``ratio`` is the log-likelihood difference for each character of host and path,
    null where a rule decides.  A null URL has an empty host and path and is judged as
    such.  Without both accepted and rejected URLs to learn from, all others are
    allowed.  Nothing but the URL decides, so repeated rows are judged alike; each
    address is learned from once, however many pages have it.  A ratio that equals the
    cutoff allows.  URLs may be of any length.  An empty table gives no rows; columns
    other than page_id and url may have any names.  Half of the ruled addresses teach
    the models, and all of the other half calibrate the cutoff; ``rows``, if given, bounds
    those of each verdict.
    """
    host, path = host_path(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, decided = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = stored(own.select("*", name.alias("rule"), decided.alias("decided")), "urls")
    address = F.concat("host", "path")
    known = ruled.where("decided is not null").select("decided", address.alias("address"))
    # by address, so that a hot one weighs as any other
    different = stored(known.distinct(), "url-addresses")
    mixed = different.withColumn("hash", F.xxhash64("address")).withColumn("apart", F.col("hash") % 2 == 0)
    sizes = {(r["decided"], r["apart"]): r["count"] for r in mixed.groupBy("decided", "apart").count().collect()}
    if not all(sizes.get((v, a)) for v in ("allow", "block") for a in (True, False)):
        return ruled.select(
            "page_id", "host", "path", "rule", F.coalesce("decided", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("ratio")
        )
    grams = learned(mixed.where(~F.col("apart")))
    apart = mixed.where("apart")
    if rows is not None:
        apart = _drawn(mixed, "allow", True, sizes, rows).unionByName(_drawn(mixed, "block", True, sizes, rows))
    apart = stored(apart.select("decided", "address"), "url-apart")
    undecided = ruled.where("decided is null").select(address.alias("address"))
    found = ratios(undecided.unionByName(apart.select("address")).distinct(), grams)
    cutoff = calibrated(apart.join(found.hint("merge"), "address").select("decided", "ratio"))
    # only undecided rows are joined, so that no null key gathers the others
    by_ratio = ruled.where("decided is null").withColumn("address", address).join(found.hint("merge"), "address").drop("address")
    scored = ruled.where("decided is not null").withColumn("ratio", F.lit(None).cast("double")).unionByName(by_ratio)
    by_model = F.when(F.col("ratio") >= cutoff, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("decided", by_model).alias("verdict"), "ratio")


def _drawn(mixed: DataFrame, verdict: str, apart: bool, sizes: dict, rows: int) -> DataFrame:
    """About ``rows`` at most, by a hash of the address."""
    share = min(1.0, rows / sizes[verdict, apart])
    return mixed.where((F.col("decided") == verdict) & (F.col("apart") == apart) & drawn(share, "hash", "address"))
