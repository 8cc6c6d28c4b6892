"""Secret scans over an incremental blob ledger, in DataFrame operations alone.

Every version of every path is content-addressed by SHA-256. The ledger says
which (blob, rule, rule version) triples were scanned; only the others are
scanned, each distinct blob once, however many paths or versions hold it.
Findings are kept with the ledger and joined back to all paths. Texts in which
no rule can match are told before any shuffle.

Spans: a rule's leftmost non-overlapping matches come from
regexp_extract_all, the text between them from split, and a running sum of
their lengths gives the offsets in code points.

Cases: null content counts as empty; empty content has no findings; very long
texts are scanned whole, and no pattern repeats a group by recursion; spans
that start alike come in the order of the rules; repeated rows of a path each
get the blob's findings; an empty table gives empty results. Extra columns are
not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import documents, materialize, shared_dir


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    version: int = 1
    #: A match counts if this group of it has so many characters; shorter ones still use up their text.
    group: int = 0
    least: int = 1


#: In the order of spans that start alike.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", version=2),
)
_GAP = r"""(?:\s|\\[nrt]|["'>#|,])*+"""
_PEM = (
    # body up to the END line, with nothing like another such line between
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-{1,4}+(?!-)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
    # or, without END, the base64 run and the shorter piece that ends it
    rf"|(?:{_GAP}(?:Proc-Type:\s*4,ENCRYPTED|DEK-Info:\s*[A-Z0-9-]++,[0-9A-Fa-f]++))*+(?:{_GAP}[A-Za-z0-9+/=]{{16,}}+)++(?:{_GAP}[A-Za-z0-9+/=]{{1,15}}+)?+|{_GAP}[A-Za-z0-9+/=]{{1,15}}+\s*+\z|)"
)
#: For replacing: a key's header is enough to find it, but all of it must go.
REDACTED = tuple(Rule("pem", _PEM, version=3) if r.kind == "pem" else r for r in RULES)
#: Folder of the registered query's ledger; unset, each run starts a new one.
FOLDER_SETTING = "spark.siltstone.secrets.folder"
BASE = ("assign", "access", "hex")
LEDGER = "blob string, kind string, version int"
FINDINGS = "blob string, kind string, start bigint, end bigint, version int"


def content_address(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def unseen(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kinds): for each blob the rules that haven't scanned it in their present version."""
    if ledger is None:
        return blobs.select("blob", F.array(*[F.lit(r.kind) for r in rules]).alias("kinds"))
    pairs = blobs.select("blob", F.inline(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])))
    return pairs.join(ledger, ["blob", "kind", "version"], "left_anti").groupBy("blob").agg(F.collect_set("kind").alias("kinds"))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, kinds) to findings (blob, kind, start, end). Repeated blobs count once."""
    one = lambda r: F.when(F.array_contains("kinds", r.kind) & F.col("text").rlike(r.pattern), F.struct(F.lit(r.kind).alias("kind"), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("hit"), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)).alias("value"), F.split("text", r.pattern, -1).alias("gap"), F.lit(r.least).alias("least")))
    per_rule = blobs.select("blob", F.explode(F.array_compact(F.array(*[one(r) for r in rules]))).alias("r"))
    each = per_rule.select("blob", "r.kind", "r.least", F.posexplode(F.arrays_zip("r.hit", "r.value", "r.gap")).alias("i", "m")).where("m.hit IS NOT NULL")
    each = each.select("blob", "kind", "i", F.length("m.hit").alias("n"), F.length("m.gap").alias("gap"), (F.length("m.value") >= F.col("least")).alias("ok")).distinct()
    end = F.sum(F.col("gap") + F.col("n")).over(W.partitionBy("blob", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return each.select("blob", "kind", (end - F.col("n")).alias("start"), end.alias("end"), "ok").where("ok").drop("ok")


def any_rule(text: F.Column, rules: tuple[Rule, ...] = RULES) -> F.Column:
    """Whether some rule's pattern is in the text."""
    return F.coalesce(F.greatest(*[text.rlike(r.pattern).cast("int") for r in rules]), F.lit(0)) == 1


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """versions (path, version, content) to (paths, findings, news).

    paths: (path, version, blob) for every row. findings: (blob, kind, start,
    end) of what this scan added. news: (blob, kind, version) rows to append to
    the ledger. A blob's text is taken from one of its rows, picked by the
    smallest hash of path and version.
    """
    row = F.xxhash64("path", "version")
    paths = versions.select("path", "version", content_address(F.col("content")).alias("blob"), row.alias("_row"))
    todo = unseen(paths.groupBy("blob").agg(F.min("_row").alias("_row")).select("blob", "_row"), ledger, rules) if ledger is not None else None
    firsts = paths.groupBy("blob").agg(F.min("_row").alias("_row"))
    firsts = firsts.withColumn("kinds", F.array(*[F.lit(r.kind) for r in rules])) if todo is None else firsts.join(todo, "blob")
    # only texts in which some rule can match are shuffled
    texts = versions.where(any_rule(F.col("content"), rules)).select(content_address(F.col("content")).alias("blob"), row.alias("_row"), F.col("content").alias("text"))
    findings = materialize(scan(texts.join(firsts, ["blob", "_row"]).select("blob", "text", "kinds"), rules))
    version = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)]), F.col("kind"))
    news = firsts.select("blob", F.explode("kinds").alias("kind")).select("blob", "kind", version.alias("version"))
    return paths.drop("_row"), findings, news


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else None


def scan_into(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(paths, findings) of all versions, with the ledger and all findings so far kept in folder.

    Only (blob, rule version) pairs that the ledger doesn't have are scanned;
    findings of earlier scans under the rules' present versions come from the
    folder. Findings are appended before the ledger rows: a scan that is cut off
    is made again and its repeated findings count once.
    """
    spark = versions.sparkSession
    paths, findings, news = scan_versions(versions, _stored(spark, f"{folder}/ledger", LEDGER), rules)
    version = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)]), F.col("kind"))
    findings.withColumn("version", version).write.mode("append").parquet(f"{folder}/findings")
    news.write.mode("append").parquet(f"{folder}/ledger")
    known = spark.read.schema(FINDINGS).parquet(f"{folder}/findings")
    return paths, known.where(F.col("version") == F.coalesce(version, F.lit(-1))).drop("version").distinct().join(paths.select("blob").distinct(), "blob", "left_semi")


def summary(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per blob: n_<kind> of the base kinds, base_sha256, spans."""
    order = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)]), F.col("kind"))
    ordered = F.array_sort(F.collect_list(F.struct("start", order.alias("o"), "kind", "end")))
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    per = findings.groupBy("blob").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE], ordered.alias("all"))
    base = F.filter("all", lambda s: s["kind"].isin(*BASE))
    return per.select("blob", *[f"n_{k}" for k in BASE], F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("all")).alias("spans"))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    versions = docs.select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), F.col("text").alias("content"))
    paths, findings = scan_into(versions, spark.conf.get(FOLDER_SETTING, f"{shared_dir(spark)}/siltstone/ledger-{uuid.uuid4().hex}"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    out = paths.join(summary(findings), "blob", "left")
    return out.select(F.col("path").alias("doc_id"), *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in BASE], F.coalesce("base_sha256", none).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = REDACTED) -> DataFrame:
    """docs with each secret's value replaced by [SECRET], private keys with body and END line; all columns and rows stay, n_chars follows the text.

    Rows without findings pass untouched; only the others meet the findings of their blob.
    """
    content = docs.select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), F.col("text").alias("content"))
    _, findings, _ = scan_versions(content, None, rules)
    spans = F.array_sort(F.collect_list(F.struct("start", "end")))
    per = findings.groupBy(F.col("blob").alias("_blob")).agg(spans.alias("_spans"))
    told = any_rule(F.col("text"), rules)
    hit = docs.where(told).withColumn("_at", content_address(F.col("text"))).join(per, F.col("_at") == F.col("_blob"), "left")
    # text up to each span that starts at or after the end of those before it; overlaps widen the one before
    done = F.aggregate(
        "_spans",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).cast("bigint").alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("[SECRET]")))).otherwise(acc["out"]).alias("out"),
        ),
    )
    hit = hit.withColumn("_done", done).withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.concat(F.array_join("_done.out", ""), F.substring(F.col("text"), (F.col("_done.at") + 1).cast("int"), F.length("text")))))
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.length("text").cast("bigint"))
    return docs.where(~told).unionByName(hit.select(*docs.columns))


_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SQL_RULES = [(r.kind, _ASSIGN if r.kind == "assign" else r.pattern, r.group, r.least) for r in RULES]
ORACLE = (
    "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), k AS ("
    + " UNION ALL ".join(f"SELECT rid, '{kind}' AS kind, {i} AS o, {least} AS least, unnest(regexp_extract_all(t, '{p}')) AS hit, unnest(regexp_extract_all(t, '{p}', {group})) AS val, unnest(string_split_regex(t, '{p}')[:len(regexp_extract_all(t, '{p}'))]) AS gap, unnest(range(len(regexp_extract_all(t, '{p}')))) AS i FROM d" for i, (kind, p, group, least) in enumerate(_SQL_RULES))
    + """), e AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY rid, kind ORDER BY i) AS e FROM k),
f AS (SELECT rid, kind, o, (e - length(hit))::BIGINT AS s, e::BIGINT AS e FROM e WHERE length(val) >= least),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""
)
