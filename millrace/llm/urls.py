"""URL filters: listed rules first, then a path-template tree for each host. DataFrame functions only.

Rules name a host and the start of a path; a rule fits its host and all subdomains, and the longest one wins. Their
verdicts, and any labels given, are what the tree learns from:

1. Segments with a variable shape (numbers, hexadecimal ids) are generalised by their shape; at each level, a node
   with many distinct children for its pages has them generalised to ``*``.
2. Branches that differ in one segment and are otherwise alike are merged into ``~`` where both have enough labels and
   the branch's share of bad pages does not differ from the pooled share by more than chance.
3. A template is blocked where its share of bad labels, smoothed towards a prior, reaches a threshold. The prior is the
   share of the same generalised path in the tree of domains above the host, smoothed level by level from the root (all
   hosts) down to the host's parent domain, so labels reach hosts and branches that have few or none of their own.

The tree starts with ``depth`` segments and is deepened twofold as long as a cut path holds enough labels of both kinds.
``evidence`` says what decided a page: ``rule``; ``host`` where its template has enough labels of its own host; ``domain`` where
only the same path of other hosts has; or nothing, and the page is allowed. So a path that is bad wherever labels judge
it is blocked on hosts without any label too: that is what the tree of domains is for, and its price.

Pages are reduced to (host, shape) counts before anything is shuffled twice; the tree is built from that table, and a
page meets it again only through the blocked templates, which are joined by (host, shape), so AQE can split a host
that holds a third of the pages. Up to INLINE_RULES rules are one expression; longer lists are joined by domain and start of the path.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, and is allowed; repeated rows
are judged alike; an empty table gives no rows; further columns are left out; equal lengths of rules go by name; of
several labels of a page, the worst counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.store import cut

INLINE_RULES = 500
#: Labels of a host that the prior looks at, from the last one on: as many as a name on the network can have.
DOMAIN_LEVELS = 127


@dataclass(frozen=True)
class Tree:
    """First depth of the tree, fan-out that makes a segment variable, the merge test and the smoothed purity that blocks."""

    depth: int = 3
    min_children: int = 20
    max_pages_per_child: float = 2.0
    min_labels: int = 8
    z: float = 2.0
    prior: float = 0.1
    strength: float = 4.0
    block_purity: float = 0.8


DEFAULT = Tree()


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    name = verdict = F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, slash, start = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + start)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def _last_labels(host: Column, k: Column) -> Column:
    return F.call_function("substring_index", host, F.lit("."), (-k).cast("int"))


def domains(host: Column) -> Column:
    """The domains above a host from the root on: ``""``, then its last label, its last two and so on, without itself."""
    labels = F.split(host, r"\.")
    most = F.least(F.size(labels) - 1, F.lit(DOMAIN_LEVELS))
    near = F.transform(F.sequence(F.lit(1), most), lambda k: _last_labels(host, k))
    return F.concat(F.array(F.lit("")), F.when(most >= 1, near).otherwise(F.array().cast("array<string>")))


def _with_joined_rules(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(host, path, rule, says) of each host and path that a rule fits, by equality of domain and start of the path."""
    split = [(r.partition("/")[0], "/" + r.partition("/")[2], r, says) for r, says in rules]
    table = pages.sparkSession.createDataFrame(split, "at string, start string, rule string, says string")
    lengths = table.groupBy("at").agg(F.collect_set(F.length("start")).alias("lengths"))
    paths = pages.select("host", "path").distinct()
    labels = F.size(F.split("host", r"\."))
    near = paths.withColumn("at", F.explode(F.transform(F.sequence(F.lit(1), labels), lambda k: _last_labels(F.col("host"), k))))
    near = near.join(lengths, "at").withColumn("k", F.explode("lengths")).where("k <= length(path)")
    fits = near.withColumn("start", F.expr("substring(path, 1, k)")).join(table, ["at", "start"])
    longest = F.max(F.struct(F.length("rule").alias("n"), "rule", "says")).alias("r")
    return fits.groupBy("host", "path").agg(longest).select("host", "path", "r.rule", "r.says")


def shape_of(path: Column, depth: int) -> Column:
    """The segments below ``depth`` levels with variable shapes generalised; deeper ones become one ``**``."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")

    def general(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^[0-9]+$"), "{n}")
            .when(s.rlike(r"^[0-9]+\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("{n}."), F.substring_index(s, ".", -1)))
            .when(s.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), "{h}")
            .otherwise(s)
        )

    deep = F.when(F.size(segments) > depth, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.transform(F.slice(segments, 1, depth), general), deep)


def _with_segment(at: int, when: Column, value: str) -> Column:
    """The template with segment ``at`` replaced where ``when`` holds."""
    return F.transform("s", lambda x, i: F.when((i == at) & when, F.lit(value)).otherwise(x))


def _priors(t: DataFrame, tree: Tree) -> DataFrame:
    """(host, g, prior, above): for each generalised path of a host its smoothed share of bad labels above the host, and their number."""
    labelled = t.where("lab > 0").select("g", "bad", "lab", F.explode(domains(F.col("host"))).alias("domain"))
    sums = labelled.groupBy("domain", "g").agg(F.sum("bad").alias("db"), F.sum("lab").alias("dl"))
    each = t.select("host", "g").distinct().select("host", "g", F.posexplode(domains(F.col("host"))).alias("level", "domain"))
    found = each.join(sums, ["domain", "g"])
    levels = found.groupBy("host", "g").agg(F.array_sort(F.collect_list(F.struct("level", "db", "dl"))).alias("levels"))
    # A domain without labels passes on what lies above it. At most as many levels as a host has labels.
    down = F.aggregate("levels", F.lit(float(tree.prior)), lambda a, x: (x["db"] + a * tree.strength) / (x["dl"] + tree.strength))
    return levels.select("host", "g", down.alias("prior"), F.expr("levels[0].dl").alias("above"))


def templates(shapes: DataFrame, tree: Tree, depth: int) -> DataFrame:
    """Each (host, shape) of a table (host, shape, s, n, bad, lab) with its template, purity and number of labels.

    ``labels`` are the template's own, ``above`` those of the same path in all hosts under the first domain with any.
    """
    t = cut(shapes)
    for d in range(depth):
        prefix = F.array_join(F.slice("s", 1, d), "/")
        here = t.where(F.size("s") > d).select("host", prefix.alias("prefix"), F.get("s", F.lit(d)).alias("child"), "n")
        fan = here.groupBy("host", "prefix", "child").agg(F.sum("n").alias("n")).groupBy("host", "prefix")
        variable = (
            fan.agg(F.count("*").alias("k"), F.sum("n").alias("pages"))
            .where((F.col("k") >= tree.min_children) & (F.col("pages") <= F.col("k") * tree.max_pages_per_child))
            .select("host", "prefix", F.lit(True).alias("variable"))
        )
        t = t.withColumn("prefix", prefix).join(variable, ["host", "prefix"], "left")
        t = cut(t.withColumn("s", _with_segment(d, F.coalesce("variable", F.lit(False)), "*")).drop("prefix", "variable"))
    t = t.withColumn("g", F.array_join("s", "/"))
    priors = _priors(t, tree)
    for d in range(depth):
        own = t.groupBy("host", "s").agg(F.sum("bad").alias("bad"), F.sum("lab").alias("lab"))
        own = own.where((F.size("s") > d) & (F.col("lab") >= tree.min_labels))
        own = own.withColumn("rest", F.array_join(_with_segment(d, F.lit(True), "~"), "/"))
        pool = own.groupBy("host", "rest").agg((F.sum("bad") / F.sum("lab")).alias("p"), F.count("*").alias("k"))
        spread = tree.z * F.sqrt(F.col("lab") * F.col("p") * (1 - F.col("p"))) + 0.5
        alike = (F.col("k") > 1) & (F.abs(F.col("bad") - F.col("lab") * F.col("p")) <= spread)
        merged = own.join(pool, ["host", "rest"]).where(alike).select("host", "s", F.lit(True).alias("merged"))
        t = t.join(merged, ["host", "s"], "left")
        t = cut(t.withColumn("s", _with_segment(d, F.coalesce("merged", F.lit(False)), "~")).drop("merged"))
    sums = t.groupBy("host", "s").agg(F.sum("bad").alias("tb"), F.sum("lab").alias("tl"))
    out = t.join(sums, ["host", "s"]).join(priors, ["host", "g"], "left")
    prior = F.coalesce("prior", F.lit(float(tree.prior)))
    purity = (F.col("tb") + prior * tree.strength) / (F.col("tl") + tree.strength)
    template = F.concat(F.lit("/"), F.array_join("s", "/")).alias("template")
    return out.select("host", "shape", template, purity.alias("purity"), F.col("tl").alias("labels"), F.coalesce("above", F.lit(0)).alias("above"))


def judge(
    pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None, tree: Tree = DEFAULT
) -> DataFrame:
    """Every page (page_id, url) with host, path, rule, verdict, the blocked template it falls under, if any, and the evidence.

    ``labels`` (page_id, bad 0 or 1) adds labelled pages to those that the rules judge.
    """
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if len(rules) <= INLINE_RULES:
        rule, says = fitting_rule(F.col("host"), F.col("path"), rules)
        base = base.withColumns({"rule": rule, "says": says})
    else:
        base = base.join(cut(_with_joined_rules(base, rules)), ["host", "path"], "left")
    bad = F.when(F.col("says").isNotNull(), (F.col("says") == "block").cast("int"))
    if labels is not None:
        given = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("given"))
        base = base.join(given, "page_id", "left")
        bad = F.coalesce(bad, F.col("given"))
    base = base.withColumn("bad", bad)
    depth = tree.depth
    while True:
        shaped = base.withColumn("s", shape_of(F.col("path"), depth)).withColumn("shape", F.array_join("s", "/"))
        counts = shaped.where("host != ''").groupBy("host", "shape", "s")
        shapes = cut(counts.agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("bad").alias("lab")))
        both = (F.col("bad") >= tree.min_labels) & (F.col("lab") - F.col("bad") >= tree.min_labels)
        if shapes.where((F.element_at("s", -1) == "**") & both).isEmpty():
            break
        depth *= 2
    enough = F.greatest("labels", "above") >= tree.min_labels
    decided = templates(shapes, tree, depth).where(enough)
    blocked = F.when(F.col("purity") >= tree.block_purity, F.col("template")).alias("template")
    source = F.when(F.col("labels") >= tree.min_labels, "host").otherwise("domain").alias("source")
    judged = shaped.join(decided.select("host", "shape", blocked, source), ["host", "shape"], "left")
    verdict = F.coalesce("says", F.when(F.col("template").isNotNull(), "block").otherwise("allow"))
    evidence = F.when(F.col("says").isNotNull(), "rule").otherwise(F.col("source")).alias("evidence")
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", evidence)
