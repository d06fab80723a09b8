"""Secret scans over an incremental ledger of content-addressed blobs. DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds the pairs of blob and
rule version that were scanned; only pairs not in it are scanned, on one copy of each blob, and findings go
back to all paths that hold the blob. A new rule version scans all blobs for that rule alone.

Spark's regular expressions tell what matched, not where. So a text is split at the matches as well: lengths
of the pieces and matches before a match add up to its start, in code points. A cheap substring test
decides whether the regular expression of a rule runs at all.

Cases: null texts count as empty. A path may have any number of versions, rows may repeat, ids may be null. Other columns
are not read. A blob without findings has none in the table of findings, and is in the ledger all the same. A text is
scanned whole; the findings of one blob become one list. An empty table has no blobs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import settled


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern; group must have least characters, or the match is dropped."""

    kind: str
    version: int
    pattern: str
    hints: tuple[str, ...] = ()  # one of them is in the lower-cased text of every match
    group: int = 0
    least: int = 0

    def may_hit(self, text: Column) -> Column:
        if not self.hints:
            return text.rlike(self.pattern)
        found = F.lit(False)
        for hint in self.hints:
            found = found | F.lower(text).contains(hint)
        return found


#: The first three are the base kinds, in their order. A run of hexadecimal digits or of key
#: characters is taken whole by its pattern, so its least length may stand in the pattern.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("password", "passwd", "secret", "token", "apikey", "api_key"), 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", ("private key-----",)),
    Rule("hosting_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", ("eyj",)),
    Rule("url_login", 1, r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,100}:[^\s:/@]{1,100}@", ("://",)),
)
BASE = ("assign", "access", "hex")


def versions(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, text, blob): every row is a version of its path."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(path_col).alias("path"), text.alias("text")).withColumn("blob", F.sha2("text", 256))


def _versions(rules: tuple[Rule, ...]) -> Column:
    return F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])


def unseen(rows: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, kinds): of each blob one copy, and the kinds of rules whose present version has not scanned it.

    Copies of a blob become one before they are shuffled, so a blob that a third of all rows hold is a row a task.
    """
    blobs = rows.groupBy("blob").agg(F.any_value("text").alias("text"))
    every = F.array(*[F.lit(r.kind) for r in rules])
    if ledger is None:
        return blobs.withColumn("kinds", every)
    done = ledger.filter(F.col("version") == _versions(rules)[F.col("kind")]).groupBy("blob").agg(F.collect_set("kind").alias("done"))
    left = blobs.join(done, "blob", "left").withColumn("kinds", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))))
    return left.filter(F.size("kinds") > 0).select("blob", "text", "kinds")


def scan(rows: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger rows) of what the ledger lacks: (blob, kind, version, start, end) and (blob, kind, version)."""
    texts = unseen(rows, ledger, rules)
    text = F.col("text")
    found = []
    for r in rules:
        pattern = F.lit(r.pattern)
        hit = F.struct(
            F.lit(r.kind).alias("kind"),
            F.lit(r.version).alias("version"),
            F.lit(r.least).alias("least"),
            F.split(text, r.pattern, -1).alias("pieces"),
            F.regexp_extract_all(text, pattern, 0).alias("matches"),
            F.regexp_extract_all(text, pattern, r.group).alias("values"),
        )
        found.append(F.when(F.array_contains("kinds", r.kind) & r.may_hit(text), hit))
    hits = texts.select("blob", F.explode(F.array_compact(F.array(*found))).alias("hit")).select("blob", "hit.*").filter(F.size("matches") > 0)
    each = hits.select("blob", "kind", "version", "least", F.posexplode(F.arrays_zip("pieces", "matches", "values")).alias("k", "x"))
    each = each.select("blob", "kind", "version", "least", "k", F.length("x.pieces").alias("gap"), F.length("x.matches").alias("size"), F.length("x.values").alias("value"))
    each = each.filter(F.col("size").isNotNull())  # the last piece has no match
    before = Window.partitionBy("blob", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    placed = each.select("blob", "kind", "version", (end - F.col("size")).alias("start"), end.alias("end"), "value", "least")
    findings = placed.filter("value >= least").select("blob", "kind", "version", "start", "end")
    blobs = rows.select("blob").distinct()
    pairs = blobs.withColumn("kind", F.explode(F.array(*[F.lit(r.kind) for r in rules]))).withColumn("version", _versions(rules)[F.col("kind")])
    return findings, pairs if ledger is None else pairs.join(ledger, ["blob", "kind", "version"], "left_anti")


def to_paths(rows: DataFrame, findings: DataFrame, base: tuple[str, ...] = BASE) -> DataFrame:
    """One row per version: (path, blob, found array<struct<start, place, kind, end>> in order, null without findings).

    The order is by start, then by the place of the kind in RULES.
    """
    place = F.create_map(*[x for k, r in enumerate(RULES) for x in (F.lit(r.kind), F.lit(k))])
    by_blob = findings.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", F.coalesce(place[F.col("kind")], F.lit(len(RULES))).alias("place"), "kind", "end"))).alias("found"))
    return rows.select("path", "blob").join(by_blob, "blob", "left")


def scan_loads(loads: list[DataFrame]) -> DataFrame:
    """The findings of all loads of versions, each scanned over the ledger of those before it: what one scan of all gives.

    Ledger and findings of a load are written before the next one reads them.
    """
    found, ledger = [], None
    for rows in loads:
        findings, fresh = scan(rows, ledger)
        found.append(settled(findings))
        if len(found) < len(loads):
            ledger = settled(fresh) if ledger is None else ledger.union(settled(fresh))
    return reduce(DataFrame.union, found)


def update(ledger_path: str, findings_path: str, docs: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> None:
    """Scan what the stored ledger lacks and append to both tables (Parquet); findings are written first.

    A run that dies between the two scans its blobs again; read findings with ``distinct()``.
    """
    spark = docs.sparkSession
    try:
        ledger = spark.read.schema("blob string, kind string, version int").parquet(ledger_path)
        ledger.limit(1).count()
    except Exception as e:  # no ledger yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        ledger = None
    findings, scanned = scan(versions(docs, path_col, text_col), ledger)
    scanned = settled(scanned)  # before the ledger changes
    findings.write.mode("append").parquet(findings_path)
    scanned.write.mode("append").parquet(ledger_path)
