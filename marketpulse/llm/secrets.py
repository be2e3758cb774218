"""Secret scan with an incremental ledger of content-addressed blobs.

Only DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketpulse.llm.common import saved


class Rule(NamedTuple):
    """``pattern`` (Java); matches whose ``group`` has under ``least`` characters are dropped.

    ``hint``: a cheap SQL test that holds for every text with a match."""
    kind: str
    pattern: str
    groups: int
    group: int
    least: int
    hint: str


def _has(*words: str) -> str:
    return " OR ".join(f"contains(lower(text), '{w}')" for w in words)


def rules() -> tuple[Rule, ...]:
    """The three base kinds in their order, then the kinds that this method adds."""
    return (
        # The base patterns.
        Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
             2, 2, 6, _has("password", "passwd", "secret", "token", "apikey", "api_key")),
        Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 20, "contains(text, 'AKIA')"),
        # A run is a match as a whole, so short runs need not be matched to be dropped.
        Rule("hex", r"[0-9a-f]{24,}", 0, 0, 24, "text RLIKE '[0-9a-f]{24}'"),
        # Added kinds.
        Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, 1, "text RLIKE 'gh[pousr]_'"),
        Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, 1, "contains(text, 'eyJ')"),
        Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0, 1, "contains(text, 'PRIVATE KEY-----')"),
    )


BASE = 3
KINDS = tuple(r.kind for r in rules())


def rules_version() -> str:
    """Names how rules are applied (how matches follow each other and are
    counted); a part of every rule's version."""
    return "leftmost-1"


def rule_versions() -> tuple[str, ...]:
    """The version of each rule: changes with any field of its own, its hint
    included, and with no other rule."""
    return tuple(hashlib.sha256(repr((rules_version(), *r)).encode()).hexdigest()[:16] for r in rules())


def _hits(number: int, r: Rule) -> Column:
    """The rule's matches in ``text``, in order: (kind, k, gap, size, good).

    ``gap`` is the text between a match and the one before.  ``\\G`` ties each
    match to the end of the last, so a text is passed over once."""
    pattern = F.lit(rf"\G((?s:.*?))({r.pattern})")

    def sizes(group: int) -> Column:
        return F.transform(F.regexp_extract_all(F.col("text"), pattern, F.lit(group)), F.length)

    pairs = F.zip_with(sizes(1), sizes(2), lambda g, s: F.struct(g.alias("gap"), s.alias("size")))
    tested = F.zip_with(pairs, sizes(2 + r.group), lambda p, n: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), (n >= r.least).alias("good")))
    found = F.transform(tested, lambda h, k: F.struct(
        F.lit(number).alias("kind"), k.alias("k"), h["gap"].alias("gap"), h["size"].alias("size"), h["good"].alias("good")))
    return F.when(F.expr(r.hint), found)


def addressed(versions: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(path, blob, text) of every historical version; a null text is the empty blob."""
    body = F.coalesce(F.col(text), F.lit(""))
    return versions.select(F.col(key).alias("path"), F.sha2(body, 256).alias("blob"), body.alias("text"))


def _texts(blobs: DataFrame) -> DataFrame:
    """Every blob once.  Copies meet already in the tasks that read them; only
    one text a task and blob is shuffled."""
    return blobs.groupBy("blob").agg(F.first("text").alias("text"))


def _scan(blobs: DataFrame) -> DataFrame:
    """``blobs`` (blob, text; distinct) -> (blob, spans: array of (start, rule version, end)).

    With a column ``todo`` (array of rule versions) a blob is scanned with those rules only."""
    nothing = F.array().cast("array<struct<kind:int,k:int,gap:int,size:int,good:boolean>>")
    named = F.array(*map(F.lit, rule_versions()))
    hits = [_hits(n, r) for n, r in enumerate(rules())]
    if "todo" in blobs.columns:
        hits = [F.when(F.array_contains("todo", v), h) for h, v in zip(hits, rule_versions(), strict=True)]
    read = saved(blobs.select("blob", F.concat(*[F.coalesce(h, nothing) for h in hits]).alias("hits")))
    so_far = Window.partitionBy("blob", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    found = read.where(F.size("hits") > 0).select("blob", F.explode("hits").alias("h")).select("blob", "h.*") \
        .withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).where("good") \
        .groupBy("blob").agg(F.sort_array(F.collect_list(F.struct(
            (F.col("end") - F.col("size")).alias("start"), F.element_at(named, F.col("kind") + 1).alias("rule"), "end"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,rule:string,end:bigint>>")
    return read.select("blob").join(found, "blob", "left").select("blob", F.coalesce("spans", empty).alias("spans"))


def update_ledger(blobs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """``blobs`` (blob, text; any number of copies) and a ledger (blob, rules,
    spans; a row a blob, ``rules`` the rule versions it was scanned with) -> the
    ledger with the missing pairs of a blob and a present rule version.

    Pairs that the ledger has are not scanned again: the content address finds
    them before the scan, and a blob meets only the rules it has not met.  Pairs
    of older versions stay.  Returned as a written table, to be kept for the next run."""
    now = F.array(*map(F.lit, rule_versions()))
    if ledger is None:
        return saved(_scan(_texts(blobs)).select("blob", now.alias("rules"), "spans"))
    ledger = ledger.select("blob", "rules", "spans")
    no_rule = F.array().cast("array<string>")
    todo = _texts(blobs).join(ledger.select("blob", "rules"), "blob", "left") \
        .withColumn("todo", F.array_except(now, F.coalesce("rules", no_rule))).where(F.size("todo") > 0).drop("rules")
    new = _scan(todo).select("blob", F.col("spans").alias("more"), F.lit(True).alias("scanned"))
    empty = F.array().cast(ledger.schema["spans"].dataType)
    known = F.coalesce("rules", no_rule)
    return saved(ledger.join(new, "blob", "full").select(
        "blob", F.when(F.col("scanned"), F.array_union(known, now)).otherwise(known).alias("rules"),
        F.concat(F.coalesce("spans", empty), F.coalesce("more", empty)).alias("spans")))


def findings(versions: DataFrame, ledger: DataFrame | None = None, key: str = "doc_id",
             text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((key, spans) for every version, the ledger after it).

    ``spans`` are (start, kind number, end) in code points, by start, then
    kind; empty where nothing is found, as for null and empty texts.  Repeated
    rows are returned each.  Only blobs with findings are joined back to the
    paths.  A very long text is scanned whole, in its row; an empty table gives
    an empty one.  Other columns are not read.
    """
    known = addressed(versions, key, text)
    ledger = update_ledger(known.select("blob", "text"), ledger)
    number = F.array(*map(F.lit, rule_versions()))
    present = F.sort_array(F.filter(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), (F.array_position(number, s["rule"]) - 1).cast("int").alias("kind"), s["end"].alias("end"))),
        lambda s: s["kind"] >= 0))
    hit = ledger.where(F.size("spans") > 0).select("blob", present.alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    rows = known.select("path", "blob").join(hit, "blob", "left") \
        .select(F.col("path").alias(key), F.coalesce("spans", empty).alias("spans"))
    return rows, ledger


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of ``findings`` rows."""
    def count(n: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < BASE)
    return rows.select(key, *[count(n).alias(f"n_{KINDS[n]}") for n in range(BASE)],
                       F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
