"""URL filter: rules first, then a tree of path templates per host.

Paths are cut into segments. Segments that are numbers, long hashes or carry digits become wildcards of their kind
row by row, so what follows works on the distinct (host, path shape) pairs with their counts, not on pages. The tree is
built from the root down, one depth at a time: children that are rare among their siblings become one wildcard, and
siblings whose labelled shares do not differ significantly are merged into one branch. A template is rejected if its
share of blocked pages, among those with a label and smoothed towards the share of all labelled pages, is high enough
and rests on enough labels. Everything is built of DataFrame functions; a hot host is only ever a group to aggregate.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Tree:
    """Depth of the tree, siblings a parent keeps by name, and the statistics of merging and rejecting.

    With `pool_labelled`, rare children with labels are pooled with the rare ones that have none, as the SQL of the
    registered query has it. Without, every child with labels keeps its name, so labels never reach other sections.
    """

    depth: int = 4
    named_children: int = 64
    pool_labelled: bool = True
    same_z: float = 1.0
    prior: float = 2.0
    purity: float = 0.8
    least_labels: int = 5


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z in lower case; empty without one."""
    host = F.regexp_extract(_after(url), r"^([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without a host."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    place = F.instr(url, "://")
    return F.when(place > 0, F.substring(url, place + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest rule (host and start of the path) that fits; a rule's host stands for its subdomains too."""
    fitting = []
    for rule in sorted(rules, key=lambda rule: (-len(rule), rule)):
        rule_host, _, start = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + start)
        fitting.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*fitting, F.lit(None).cast("string"))


def segment_shape(segment: Column) -> Column:
    """A wildcard for numbers, hashes and segments with digits, which keeps a file ending; else the segment."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    body = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    return (
        F.when(body.rlike(r"^[0-9]+$"), F.concat(F.lit("{n}"), ending))
        .when(body.rlike(r"^[0-9a-fA-F-]{8,}$") & body.rlike("[0-9]"), F.concat(F.lit("{hex}"), ending))
        .when(body.rlike("[0-9]"), F.concat(F.lit("{x}"), ending))
        .otherwise(segment)
    )


def path_shape(path: Column) -> Column:
    """The shapes of the segments that are not empty, joined by slashes."""
    return F.array_join(F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), segment_shape), "/")


def _share(blocked: Column, labelled: Column, prior: Column, weight: float) -> Column:
    return (blocked + F.lit(weight) * prior) / (labelled + F.lit(weight))


def _grown(leaves: DataFrame, at: int, rule: Tree) -> DataFrame:
    """`leaves` with the branch of depth `at` appended to their templates.

    A parent keeps children by name only if they hold at least one in `named_children` of its pages, so the windows over
    siblings see a bounded number of them. If children with labels keep their names whatever their size, the windows see
    siblings with equal counts as one, and a branch of several is named by the least of them and the number of others.
    """
    child = F.get(F.split("shape", "/"), at)
    here = leaves.withColumn("child", F.when((child != "") & child.isNotNull(), child))
    parents = here.groupBy(F.col("host").alias("p_host"), F.col("template").alias("p_template")).agg(F.sum("n").alias("p_n"))
    children = here.filter("child is not null").groupBy("host", "template", "child").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    sized = children.join(parents, (F.col("host") == F.col("p_host")) & (F.col("template") == F.col("p_template")))
    named = F.col("n") * rule.named_children >= F.col("p_n")
    if not rule.pool_labelled:
        named = named | (F.col("labelled") > 0)
    sized = sized.select("host", "template", "child", F.when(named | F.col("child").startswith("{"), F.col("child")).otherwise("*").alias("name"), "labelled", "blocked")
    names = sized.groupBy("host", "template", "name").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    # Siblings with labels, in order of their share; a new branch begins where the step is significant.
    share = _share(F.col("blocked"), F.col("labelled"), F.lit(0.5), 2.0)
    spread = share * (1 - share) / (F.col("labelled") + 2.0)
    siblings = names.filter("labelled > 0")
    alike = siblings if rule.pool_labelled else siblings.select("host", "template", "labelled", "blocked").distinct()
    order = Window.partitionBy("host", "template").orderBy("share", "name" if rule.pool_labelled else "labelled")
    step = F.col("share") - F.lag("share").over(order)
    apart = F.coalesce(step > F.lit(rule.same_z) * F.sqrt(F.col("spread") + F.lag("spread").over(order)), F.lit(True))
    cluster = alike.withColumn("share", share).withColumn("spread", spread).withColumn("apart", apart)
    cluster = cluster.withColumn("branch", F.sum(F.col("apart").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if rule.pool_labelled:
        merged = cluster.groupBy(F.col("host").alias("m_host"), F.col("template").alias("m_template"), "branch").agg(F.sort_array(F.collect_set("name")).alias("names"))
        merged = merged.select("m_host", "m_template", F.explode("names").alias("m_name"), F.array_join("names", "|").alias("branch_name"))
    else:
        merged = _named_by_least(siblings, cluster.select("host", "template", "labelled", "blocked", "branch"))
    branches = sized.join(merged, (F.col("host") == F.col("m_host")) & (F.col("template") == F.col("m_template")) & (F.col("name") == F.col("m_name")), "left")
    branches = branches.select(F.col("host").alias("b_host"), F.col("template").alias("b_template"), F.col("child").alias("b_child"), F.coalesce("branch_name", "name").alias("branch_name"))
    joined = here.join(branches, (F.col("host") == F.col("b_host")) & (F.col("template") == F.col("b_template")) & (F.col("child") == F.col("b_child")), "left")
    longer = F.when(F.col("branch_name").isNotNull(), F.concat("template", F.lit("/"), "branch_name")).otherwise(F.col("template"))
    return joined.select("host", "shape", longer.alias("template"), "n", "labelled", "blocked")


def _named_by_least(siblings: DataFrame, cluster: DataFrame) -> DataFrame:
    """The branch of each sibling, found by its counts; names of any number of siblings are not brought together."""
    own = siblings.join(cluster, ["host", "template", "labelled", "blocked"])
    least = own.groupBy("host", "template", "branch").agg(F.min("name").alias("least"), F.count(F.lit(1)).alias("n"))
    label = F.when(F.col("n") == 1, F.col("least")).otherwise(F.concat("least", F.lit("|+"), (F.col("n") - 1).cast("string")))
    found = own.join(least, ["host", "template", "branch"])
    return found.select(F.col("host").alias("m_host"), F.col("template").alias("m_template"), F.col("name").alias("m_name"), label.alias("branch_name"))


def judged_templates(pages: DataFrame, rule: Tree = Tree()) -> DataFrame:
    """Pages (host, shape, blocked or null) as shapes with their template, its smoothed share and whether it is rejected."""
    blocked = F.sum(F.when(F.col("blocked"), 1).otherwise(0))
    leaves = stage(pages.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("blocked").alias("labelled"), blocked.alias("blocked")).withColumn("template", F.lit("")), name="shapes")
    for at in range(rule.depth):
        leaves = stage(_grown(leaves, at, rule), name="templates")
    everywhere = leaves.agg(((F.sum("blocked") + 1) / (F.sum("labelled") + 2)).alias("prior"))
    sums = leaves.groupBy(F.col("host").alias("t_host"), F.col("template").alias("t_template")).agg(F.sum("labelled").alias("t_labelled"), F.sum("blocked").alias("t_blocked"))
    purity = _share(F.col("t_blocked"), F.col("t_labelled"), F.col("prior"), rule.prior)
    sums = sums.join(F.broadcast(everywhere)).select("t_host", "t_template", purity.alias("purity"), ((F.col("t_labelled") >= rule.least_labels) & (purity >= rule.purity)).alias("rejected"))
    return leaves.join(sums, (F.col("host") == F.col("t_host")) & (F.col("template") == F.col("t_template"))).select("host", "shape", "template", "purity", "rejected")


def filter_urls(pages: DataFrame, allow: Sequence[str], block: Sequence[str], key: str = "page_id", url: str = "url", rule: Tree = Tree()) -> DataFrame:
    """key, host, path, rule, verdict, template and purity of every page.

    The longest fitting rule decides; pages without one get the verdict of their path template, which learns from the
    pages that rules have decided. A null url, or one without ://, has empty host and path and is a page of the empty
    host. Null keys stay null, repeated pages count each. Segments deeper than the tree tell templates apart no more.
    Other columns are not read. An empty table gives an empty result.
    """
    split = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = split.withColumn("rule", rule_of(F.col("host"), F.col("path"), [*allow, *block])).withColumn("shape", path_shape(F.col("path")))
    blocked = F.when(F.col("rule").isNotNull(), F.col("rule").isin(list(block)))
    templates = judged_templates(ruled.select("host", "shape", blocked.alias("blocked")), rule)
    templates = templates.select(F.col("host").alias("t_host"), F.col("shape").alias("t_shape"), "template", "purity", "rejected")
    joined = ruled.join(templates, (F.col("host") == F.col("t_host")) & (F.col("shape") == F.col("t_shape")))
    verdict = F.when(F.coalesce(blocked, F.col("rejected")), "block").otherwise("allow")
    return joined.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
