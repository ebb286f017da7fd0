"""URL filter: host and path rules, else ratios of character language models of names and of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.storage import Scratch

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Labelled sample of rejected hosts, a parameter: invented names of the kinds that URL filters are asked to stop (gambling,
#: adult, sham pharmacies, loans, advertising and tracking, link farms).  They teach the rejected model its characters.
REJECTED_HOSTS = (
    "adult-cams", "ad-server", "ads-network", "affiliate-links", "best-bets", "betting-tips", "bonus-casino", "buy-followers", "buy-pills", "cam-girls",
    "cash-bets", "casino-bonus", "cheap-meds", "discount-pills", "click-ads", "content-farm", "crypto-win", "easy-loans", "fast-cash", "free-casino",
    "free-coins", "free-porn", "hot-videos", "jackpot-win", "link-farm", "live-casino", "lotto-win", "lucky-bets", "online-casino", "payday-loans",
    "pixel-track", "poker-win", "porn-tube", "seo-spam", "slots-win", "spam-links", "sports-bets", "tracking-ads", "viagra-shop", "xxx-videos",
)
#: Labels before a country's that belong to the suffix and name no domain.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "gv", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
ORDER = 4
#: Names are scored in so many parts, each by models of the others.
PARTS = 5


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Null or without ``://``: both empty.  The host ends at the first of / ? #, the path at the first of ? #."""
    has = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    rest = F.expr("substring(_url, locate('://', _url) + 3)")
    host = F.when(has, lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise("")
    path = F.when(has, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def matching_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Rule text and verdict of the longest rule that fits.  Rules are a parameter of bounded number, so they are a chain of
    conditions, longest first."""
    text = verdict = None
    for kind, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, slash, tail = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(slash + tail))
        text = F.when(fits, rule) if text is None else text.when(fits, rule)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (text, verdict) if text is not None else (none, none)


def site_name(host: Column) -> Column:
    """The host without its last two labels and a leading www or m; hosts of two labels or fewer keep the first, and hosts that
    have only www or m before the last two keep the first of those two, so every host with a label has a name."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    inner = F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(1)))
    own = F.filter(inner, lambda x: ~x.isin("www", "m"))
    return F.when(F.size(own) > 0, F.array_join(own, ".")).otherwise(F.coalesce(F.get(labels, F.greatest(F.size(labels) - 2, F.lit(0))), F.lit("")))


def domain_label(host: Column) -> Column:
    """The domain's own label where the name is that of a subdomain: the last but one of three or more, and where that belongs
    to a suffix (``co.uk``) the one before it, if the host has a label left of it."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    second = F.get(labels, n - 2)
    suffix = second.isin(*SECOND_LEVEL)
    return F.when((n >= 3) & ~suffix, second).when((n >= 4) & suffix, F.get(labels, n - 3)).otherwise("")


def model_ratio(grams: DataFrame, scratch: Scratch, order: int = ORDER, by: tuple[str, ...] = ()) -> DataFrame:
    """``(*by, gram, lr)``: log ratio of accepted to rejected probability of a gram's last character after the others, of one
    pair of models for each value of ``by`` (a bounded number of them).

    Both models interpolate orders 0 to ``order - 1`` by Witten-Bell: an order counts the more, the fewer kinds of characters
    followed its context; a context never seen leaves all to the shorter one.  All counts of lower orders are sums over the
    table of longest grams, so the URLs are read once.
    """
    both = ("ok", "bad")
    full = scratch.save(grams.groupBy(*by, "gram").agg(*(F.sum(c).cast("double").alias(c) for c in both)))
    last = None
    for k in range(1, order + 1):
        g = full.groupBy(*by, F.expr(f"right(gram, {k})").alias("gram")).agg(*(F.sum(c).alias(c) for c in both))
        if k == 1:
            totals = g.groupBy(*by).agg(*(F.sum(c).alias(f"n_{c}") for c in both), F.count(F.lit(1)).cast("double").alias("v"))
            g = g.join(totals, list(by)) if by else g.crossJoin(F.broadcast(totals))
            last = g.select(*by, "gram", *(((F.col(c) + 1.0) / (F.col(f"n_{c}") + F.col("v") + 1.0)).alias(f"p_{c}") for c in both))
        else:
            g = g.withColumn("ctx", F.expr(f"left(gram, {k - 1})")).withColumn("tail", F.expr(f"right(gram, {k - 1})"))
            kinds = [F.sum(F.when(F.col(c) > 0, 1.0).otherwise(0.0)).alias(f"t_{c}") for c in both]
            ctx = g.groupBy(*by, "ctx").agg(*(F.sum(c).alias(f"n_{c}") for c in both), *kinds)
            g = g.join(ctx, [*by, "ctx"]).join(last.withColumnRenamed("gram", "tail"), [*by, "tail"])
            mixed = {c: (F.col(c) + F.col(f"t_{c}") * F.col(f"p_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}")) for c in both}
            last = g.select(*by, "gram", *(F.when(F.col(f"n_{c}") == 0, F.col(f"p_{c}")).otherwise(mixed[c]).alias(f"p_{c}") for c in both))
        last = scratch.save(last)
    return last.select(*by, "gram", (F.ln("p_ok") - F.ln("p_bad")).alias("lr"))


def word_grams(line: Column, order: int) -> Column:
    """``array<struct<word, gram>>`` of a line that starts with ``order - 1`` marks and ends with one: grams that end in a word
    (letters, digits, hyphens) or in the character after it, numbered by word."""
    text = F.substr(line, F.lit(order), F.length(line))
    pieces = F.regexp_extract_all(text, F.lit("([^a-z0-9-]*[a-z0-9-]+[^a-z0-9-]?)"), 1)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<word: int, at: int, size: int>>)").alias("all"))

    def put(acc, piece):
        size = F.length(piece)
        here = F.struct(F.size(acc["all"]).alias("word"), acc["at"].alias("at"), size.alias("size"))
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["all"], F.array(here)).alias("all"))

    spans = F.aggregate(pieces, start, put, lambda acc: acc["all"])
    return F.flatten(F.transform(spans, lambda s: F.transform(F.sequence(F.lit(1), s["size"]), lambda i: F.struct(s["word"].alias("word"), F.substring(line, s["at"] + i, F.lit(order)).alias("gram")))))


def held_out_scores(texts: DataFrame, cut: Column, scratch: Scratch, order: int, parts: int) -> DataFrame:
    """``(name, bad, word, score)``: mean log ratio of the grams of each word of ``texts(name, blocked, bad, part, ...)``, by the
    models of the other parts.  ``cut`` gives a text's grams with their word."""
    grams = texts.select("name", "part", "bad", (~F.col("blocked") & (F.col("bad") == 0)).cast("int").alias("ok"), F.explode(cut).alias("_g")).select("name", "part", "bad", "ok", "_g.word", "_g.gram")
    # what a part teaches counts in the models of all other parts; in its own its grams are known, with no count
    counts = grams.groupBy("part", "gram").agg(F.sum("ok").alias("ok"), F.sum((F.col("bad") == 1).cast("int")).alias("bad"))
    teach = counts.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    other = [F.when(F.col("part") != F.col("model"), F.col(c)).otherwise(0).alias(c) for c in ("ok", "bad")]
    ratio = model_ratio(teach.select(F.col("model").alias("part"), "gram", *other), scratch, order, ("part",))
    return scratch.save(grams.join(ratio, ["part", "gram"]).groupBy("name", "bad", "word").agg(F.avg("lr").alias("score")))


def medians(scored: DataFrame) -> dict[int, float]:
    return {r["bad"]: r["m"] for r in scored.groupBy("bad").agg(F.percentile_approx("score", 0.5, 10_000).alias("m")).collect()}


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, rejected_hosts=REJECTED_HOSTS, order: int = ORDER, parts: int = PARTS) -> DataFrame:
    """``(id_col, host, path, rule, verdict, score, domain_score, path_score)``, one row for each row of ``pages``.

    Names: the accepted model learns the characters of the hosts (``site_name``) of all pages, each once, that have a URL no
    rule blocks, the rejected one those of the labelled sample ``rejected_hosts``.  Rules speak of domains and languages, which
    tell nothing of a name, so hosts whose URLs are all blocked teach neither.  Names and sample are dealt into ``parts`` by
    their last label; each part is scored by models of the other parts, so no name is scored by what it taught.  The score is
    the log-likelihood difference (accepted less rejected) a character.  A domain's own label below which the name stands
    (``domain_label``) is scored by the same models and teaches neither.

    Paths and queries have a second pair of models: the accepted one learns the lines of path and query of URLs that no rule
    blocks, numbers written as 0, each line once; the rejected one the sample's names as path words.  Lines are dealt into parts
    by their hash.  The score of a line is that of its worst word.

    A URL without a rule is blocked if the score of its name is below the threshold, which is halfway between the median score of
    the sample and that of the pages' names, and 0 at most; or if that of its domain's label is below the median of the sample's
    names, or that of its path below the median of the sample's path words, and 0 at most.  Labels teach no model and words of
    paths are many, so these need to look more like the sample than half of the sample does.  Null and empty parts have no score and block nothing, as do models that have
    no training text of either kind.  Repeated rows keep their rows; null ids stay; an empty table gives no rows; other columns
    are not read.
    """
    scratch = Scratch(pages.sparkSession)
    d = pages.select(F.col(id_col).alias("_id"), F.coalesce(F.col(url_col), F.lit("")).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    d = d.select("_id", "_url", host.alias("host"), path.alias("path"))
    rule, kind = matching_rule(F.col("host"), F.col("path"), rules)
    way = F.when(F.locate("://", F.col("_url")) > 0, F.regexp_extract("_url", r"(?s)^.*?://[^/?#]*([^#]*)", 1)).otherwise("")
    d = d.withColumn("rule", rule).withColumn("kind", kind).withColumn("name", site_name(F.col("host"))).withColumn("label", domain_label(F.col("host")))
    d = d.withColumn("way", F.regexp_replace(lower_ascii(way), "[0-9]+", "0")).drop("_url")
    line = lambda c: F.concat(F.lit("\u0002" * (order - 1)), F.regexp_replace(c, r"[^\x21-\x7e]", "\u0001"), F.lit("\u0003"))
    blocked = F.min(F.coalesce(F.col("kind") == "block", F.lit(False))).alias("blocked")
    sample = pages.sparkSession.createDataFrame([(h,) for h in rejected_hosts], "name string").select("name", F.lit(False).alias("blocked"), F.lit(1).alias("bad"))

    # equal names share their grams: each is cut up once; a name of the sample has kind 1, one of the pages 0, a label 2
    names = d.filter("name <> ''").groupBy("name").agg(blocked).withColumn("bad", F.lit(0))
    labels = d.filter("label <> ''").select(F.col("label").alias("name"), F.lit(True).alias("blocked"), F.lit(2).alias("bad")).distinct()
    names = names.unionByName(labels)
    part = F.pmod(F.xxhash64(F.substring_index("name", ".", -1)), F.lit(parts)).cast("int")
    names = scratch.save(names.unionByName(sample).withColumn("part", part).withColumn("line", line(F.col("name"))))
    whole = F.transform(F.sequence(F.lit(1), F.length("line") - (order - 1)), lambda i: F.struct(F.lit(0).alias("word"), F.substring("line", i, F.lit(order)).alias("gram")))
    scored = held_out_scores(names, whole, scratch, order, parts)
    median = medians(scored)
    level = min(0.0, (median[0] + median[1]) / 2) if {0, 1} <= median.keys() else float("-inf")
    label_level = min(0.0, median[1]) if {0, 1} <= median.keys() else float("-inf")

    ways = d.filter("way <> ''").groupBy(F.col("way").alias("name")).agg(blocked).withColumn("bad", F.lit(0))
    ways = ways.unionByName(sample.withColumn("name", F.concat(F.lit("/"), "name", F.lit("/"))))
    ways = scratch.save(ways.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int")).withColumn("line", line(F.col("name"))))
    words = held_out_scores(ways, word_grams(F.col("line"), order), scratch, order, parts)
    sampled = medians(words)
    way_level = min(0.0, sampled[1]) if {0, 1} <= sampled.keys() else float("-inf")

    name_scores = scored.filter("bad = 0").select("name", "score")
    label_scores = scored.filter("bad = 2").select(F.col("name").alias("label"), F.col("score").alias("domain_score"))
    way_scores = words.filter("bad = 0").groupBy(F.col("name").alias("way")).agg(F.min("score").alias("path_score"))
    out = d.join(name_scores, "name", "left").join(label_scores, "label", "left").join(way_scores, "way", "left")
    low = (F.col("score") < F.lit(level)) | (F.col("domain_score") < F.lit(label_level)) | (F.col("path_score") < F.lit(way_level))
    verdict = F.coalesce("kind", F.when(low, "block").otherwise("allow"))
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score", "domain_score", "path_score")
