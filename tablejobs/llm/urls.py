"""URL filters: explicit rules, then path templates learnt from labelled pages.

Rules first: the longest that fits decides. For the rest, each host's paths form
a tree of segments, which is generalised from the root down:

1. Segments that vary by form become classes: numbers, hexadecimal ids, dates.
2. A node with many children of little support each gets one wildcard child.
3. Children whose labelled share of rejected pages does not differ from their
   siblings' (a two-sided test) are merged into the wildcard child; those that
   differ stay branches of their own.

A template (host and generalised path) is rejected if the smoothed share of
accepted labels, its purity, is too low; smoothing leans on the host's share and
that on the whole table's.

At scale: the tree is built level by level from counts by (host, path form), so
a host with a third of all pages is as many rows as it has forms; page rows are
only joined once, by (host, form), a join whose large partitions can be split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tablejobs.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WILDCARD = "*"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Settings:
    #: A node with more children than this, of fewer pages each than the other
    #: on average, varies.
    most_children: int = 20
    least_support: float = 5.0
    #: Children whose rejected share is fewer standard errors from their
    #: siblings' are alike.
    alike: float = 1.96
    #: Labels that the smoothing is worth.
    prior: float = 5.0
    #: Templates of less purity are rejected.
    least_purity: float = 0.5
    #: Segments from this one on are one.
    levels: int = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lowered."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of text and verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the last that fits is the longest
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def form_of(segment: Column) -> Column:
    """A segment, or the class of those that vary by form; file endings stay."""
    stem = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]{2,5})?$", 1)
    end = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]{2,5})?$", 2)
    kind = (F.when(stem.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), F.lit("<date>"))
            .when(stem.rlike(r"^[0-9]+$"), F.lit("<number>"))
            .when(stem.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.lit("<hex>")).otherwise(stem))
    return F.concat(kind, end)


def _forms(path: Column, levels: int) -> Column:
    parts = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), form_of)
    tail = F.array_join(F.slice(parts, levels, F.greatest(F.size(parts) - levels + 1, F.lit(0))), "/")
    return F.when(F.size(parts) <= levels, parts).otherwise(F.concat(F.slice(parts, 1, levels - 1), F.array(tail)))


def templates(forms: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``template`` and ``purity`` for each row of ``host``, ``forms`` (array),
    ``n``, ``labelled`` and ``rejected`` counts."""
    tree = forms.withColumn("prefix", F.lit("")).withColumn("depth", F.size("forms"))
    tree = materialize(tree, "url-forms")
    deepest = tree.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]  # at most settings.levels
    for level in range(deepest):
        here = tree.where(F.col("depth") > level).withColumn("seg", F.get("forms", F.lit(level)))
        children = here.groupBy("host", "prefix", "seg").agg(
            F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("rejected").alias("rejected"))
        nodes = children.groupBy("host", "prefix").agg(
            F.count("*").alias("c"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"),
            F.sum("rejected").alias("all_rejected"))
        share = (F.col("all_rejected") + 0.5) / (F.col("all_labelled") + 1.0)
        error = F.sqrt(F.col("labelled") * share * (1 - share))
        differs = (F.col("labelled") > 0) & (F.abs(F.col("rejected") - F.col("labelled") * share) > settings.alike * error)
        varies = (F.col("c") > settings.most_children) & (F.col("all_n") / F.col("c") < settings.least_support)
        name = (F.when(F.col("c") == 1, F.col("seg")).when(varies | ~differs, F.lit(WILDCARD)).otherwise(F.col("seg")))
        named = children.join(nodes, ["host", "prefix"]).select("host", "prefix", "seg", name.alias("name"))
        grown = (here.join(named, ["host", "prefix", "seg"])
                 .withColumn("prefix", F.concat("prefix", F.lit("/"), "name")).drop("seg", "name"))
        tree = materialize(grown.unionByName(tree.where(F.col("depth") <= level)), "url-tree")
    counts = [F.sum("labelled").alias("l"), F.sum("rejected").alias("r")]
    total = tree.agg(*counts).select(((F.col("l") - F.col("r") + 1) / (F.col("l") + 2)).alias("p")).first()
    of_all = F.lit(total[0] if total[0] is not None else 0.5)
    smooth = lambda to: (F.col("l") - F.col("r") + settings.prior * to) / (F.col("l") + settings.prior)
    hosts = tree.groupBy("host").agg(*counts).select("host", smooth(of_all).alias("host_purity"))
    pure = (tree.groupBy("host", "prefix").agg(*counts).join(hosts, "host")
            .select("host", "prefix", smooth(F.col("host_purity")).alias("purity")))
    return tree.join(pure, ["host", "prefix"]).select("host", "forms", F.concat("host", "prefix").alias("template"), "purity")


def filter_urls(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None,
                settings: Settings = Settings(), id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """For each row of ``pages``: its id, ``host``, ``path``, the ``rule`` that
    decided (else null), the ``verdict`` (allow or block), and the ``template``
    with its ``purity``.

    ``labels`` has the id column and ``rejected`` (0 or 1; other values and rows
    without a page count for nothing; several labels of one page all count).
    Without labels every template has the even prior and is allowed. A null URL
    or one without ``://`` has empty host and path, no rule, and the template of
    the empty host. Repeated rows and null ids each keep a result; an empty table
    gives an empty result; further columns of either side play no part.
    """
    page = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"))
    page = page.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    page = page.withColumn("forms", _forms(F.col("path"), settings.levels))
    counts = page.groupBy("host", "forms").agg(F.count("*").alias("n"))
    if labels is None:
        told = counts.select("host", "forms", F.lit(0).alias("labelled"), F.lit(0).alias("rejected")).limit(0)
    else:
        # One row for each labelled id, so a page that repeats is joined to one.
        mark = (labels.select(F.col(id_column).alias("page_id"), F.col("rejected").cast("int").alias("rejected"))
                .where("rejected IN (0, 1) AND page_id IS NOT NULL")
                .groupBy("page_id").agg(F.count("*").alias("labelled"), F.sum("rejected").alias("rejected")))
        told = (page.join(mark, "page_id").groupBy("host", "forms")
                .agg(F.sum("labelled").alias("labelled"), F.sum("rejected").alias("rejected")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    forms = counts.join(told, ["host", "forms"], "left").select("host", "forms", "n", zero("labelled"), zero("rejected"))
    learnt = templates(forms, settings)
    found = rule_for(F.col("host"), F.col("path"), rules)
    by_purity = F.when(F.col("purity") < settings.least_purity, "block").otherwise("allow")
    return (page.join(learnt, ["host", "forms"]).withColumn("_found", found)
            .select(F.col("page_id").alias(id_column), "host", "path", F.col("_found.rule").alias("rule"),
                    F.coalesce(F.col("_found.verdict"), by_purity).alias("verdict"), "template", "purity"))
