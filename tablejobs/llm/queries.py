"""The registered queries of this subpackage, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablejobs.session import load_table

from . import containment, licences, manifest, mixing, neighbours, periodic, private, quality, similar, substrings, tokens, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its oracle SQL."""
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return register


@query()
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (substrings.remove_repeats(load_table(spark, sf_dir, "documents"), window=35)
            .select("doc_id", "n_words", "n_removed", "kept_sha256"))


@query()
def op5_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.encode_documents(load_table(spark, sf_dir, "documents"),
                                   public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


_SHINGLES = r"""
  SELECT DISTINCT {id}, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT {id}, w, unnest(range(1, len(w) - 3)) AS i
        FROM (SELECT {id}, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM {table})
        WHERE len(w) >= 5)"""


@query(f"""
WITH d AS ({_SHINGLES.format(id='doc_id', table='documents')}),
     b AS ({_SHINGLES.format(id='item_id', table='benchmark')}),
     n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared,
       count(*)::double / n_shingles AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles
""")
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.find_contained(load_table(spark, sf_dir, "documents"),
                                      load_table(spark, sf_dir, "benchmark"), threshold=0.8)


@query(r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
     s0 AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
     s1 AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::double AS w,
                   3 * source_size AS cap, sum(source_size) OVER () AS total FROM s0),
     s2 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::double
                   / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
     s3 AS (SELECT source, source_size, least(cap::double, w * max(level) OVER ()) AS target, cap FROM s2),
     s AS (SELECT *, least(cap, round(target)::bigint) AS quota FROM s3),
     p AS (SELECT d.doc_id, d.size, s.source_size, s.target, s.quota,
                  (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::varchar), d.size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::bigint AS b
           FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size::bigint AS size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE
         (quota // source_size) * size + least(b, quota % source_size) - least(b - size, quota % source_size)
       END::bigint AS taken FROM p
""")
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(load_table(spark, sf_dir, "documents"))


@query()
def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.find_private(load_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("private_spans", lambda s: s["kind"].isin(*private.BASE_KINDS))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return (found.select("doc_id", base.alias("base"), private.joined(F.col("private_spans")).alias("spans"))
            .select("doc_id", *[count(k).alias(f"n_{k}") for k in private.BASE_KINDS],
                    F.sha2(private.joined(F.col("base")), 256).alias("base_sha256"), "spans"))


def _licence_values() -> str:
    rows = []
    for i, (name, text) in enumerate(licences.TEMPLATES):
        rows += [f"({i}, '{name}', '{b}')" for b in licences.template_bigrams(text)]
    return ", ".join(rows)


@query(rf"""
WITH t AS (SELECT * FROM (VALUES {_licence_values()}) AS v(t, licence, b)),
     tn AS (SELECT t, licence, count(*) AS n FROM t GROUP BY ALL),
     d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS x FROM documents),
     u AS (SELECT r, 'text' AS unit, 0 AS place, x FROM d
           UNION ALL SELECT r, 'paragraph', generate_subscripts(p, 1) - 1, unnest(p)
                     FROM (SELECT r, string_split_regex(x, '\n *\n[ \n]*') AS p FROM d)
           UNION ALL SELECT r, 'line', generate_subscripts(p, 1) - 1, unnest(p) FROM (SELECT r, string_split(x, chr(10)) AS p FROM d)),
     w AS (SELECT r, unit, place, list_filter(string_split_regex(x, '[ \n]+'), lambda y: y <> '') AS w FROM u),
     b AS (SELECT DISTINCT r, unit, place, w[i] || ' ' || w[i + 1] AS b
           FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1)),
     n AS (SELECT r, unit, place, count(*) AS n FROM b GROUP BY ALL),
     m AS (SELECT r, unit, place, t, count(*) AS c FROM b JOIN t USING (b) GROUP BY ALL),
     s AS (SELECT r, unit, place, licence, max(2.0::double * c / (n.n + tn.n)) AS dice
           FROM m JOIN n USING (r, unit, place) JOIN tn USING (t) GROUP BY ALL HAVING dice >= 0.9 - 1e-9)
SELECT doc_id, coalesce(string_agg(DISTINCT licence, ',' ORDER BY licence), '') AS licences,
       count(dice) AS n_units, max(dice) AS best_dice
FROM d LEFT JOIN s USING (r) GROUP BY r, doc_id
""")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.find_licences(load_table(spark, sf_dir, "documents").select("doc_id", "text"))
    units = F.col("licence_units")
    return found.select("doc_id", units).select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(units["licence"])), ",").alias("licences"),
        F.size(units).cast("long").alias("n_units"), F.array_max(units["dice"]).alias("best_dice"))


#: Fixed values of the query.
URL_RULES = [urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"),
             urls.Rule("block", "example.org", "/en/1"), urls.Rule("allow", "com", "/fr/"),
             urls.Rule("block", "com", "/de/")]


@query()
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load_table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("rejected"))
    return urls.filter_urls(load_table(spark, sf_dir, "pages"), URL_RULES, labels)


def held_out(doc_id: Column) -> Column:
    """Whether a document is for testing: its labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    labels = load_table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return toxicity.train(docs, labels.select("doc_id", F.col("toxic").alias("label")))


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(load_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query()
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_documents(load_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def tampered(doc_id: Column) -> Column:
    """Rows whose text the manifest check sees altered: crc32 of the decimal id even."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 2 == 0, F.lit(False))


@query()
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    text = F.when(tampered(F.col("doc_id")), F.translate("text", "\n", "")).otherwise(F.col("text"))
    seen = manifest.leaf_digest([text if f == "text" else F.col(f) for f in manifest.LEAF_FIELDS])
    built = manifest.manifest(docs.withColumn("_seen", seen), carry=["doc_id", "_seen"])
    return built.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"),
                        manifest.fold(F.col("_seen"), F.col("path")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


@query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.periodic_runs(docs, alter=True).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@query()
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(load_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "log_ppl")
