"""Secret scans through a trigram index.

Each rule's regular expression gives a Boolean query over trigrams (see ``trigrams``). The texts
are indexed by the trigrams of all queries: a posting is a trigram and the key of a text that holds
it. Postings are intersected by counting, for each text and each alternative of a rule, how many
of its trigrams are there. Only texts that satisfy a rule's query are matched against its regular
expression; rules without mandatory trigrams are matched against all texts.

Everything on this path is a DataFrame function.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graincart.llm.common import broadcast_if_small, lower_ascii, materialize, text_key, with_rest
from graincart.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds spans from left to right; a span counts if group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False


#: A private key in PEM form or of PGP: banner, headers (up to four of PGP's), and all up to the END line. Without
#: one it goes to the last long line of base64 (also quoted, indented or with breaks written \n), and
#: a short line below that stands alone. No group repeats, so that Java needs no stack for long texts.
_PEM_HEAD = r"""-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----""" + 4 * r"(?:\s*(?:Version|Comment|MessageID|Hash|Charset):[^\r\n]*)?" + r"""(?:[\x20\t\r\n\\>#"]*n?Proc-Type:[^-]*DEK-Info:[\x20A-Za-z0-9,-]*)?"""
_PEM_END = r"[^-]*-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
_PEM_OPEN = r"""(?:[A-Za-z0-9+/=\x20\t\r\n\\>#"]*[A-Za-z0-9+/=]{40,})?(?:(?:\r?\n|\\n)[\x20\t]*[A-Za-z0-9+/]+={0,2}(?:\r|(?m:$)))?"""

#: The rules, in the order in which kinds are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", f"{_PEM_HEAD}(?:{_PEM_END}|{_PEM_OPEN})"),
)
BASE = ("assign", "access", "hex")


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(text_key, rules): the texts that hold the mandatory trigrams of a rule, and which rules."""
    spark = docs.sparkSession
    terms = [(r.kind, i, t, len(alt)) for r in rules for i, alt in enumerate(trigram_query(r.pattern)) for t in sorted(alt)]
    held = [F.when(F.contains(F.col("folded"), F.lit(t)), F.lit(t)) for t in sorted({t for _, _, t, _ in terms})]
    texts = docs.where("text <> ''").select(F.md5("text").alias("text_key"), lower_ascii(F.col("text")).alias("folded"))
    postings = texts.select("text_key", F.explode(F.array_compact(F.array(*held))).alias("trigram"))
    # the queries are a fixed table of a few dozen rows
    queries = F.broadcast(spark.createDataFrame(terms, "rule string, alternative int, trigram string, trigrams int"))
    # equal texts have equal postings: their trigrams count once
    met = postings.join(queries, "trigram").groupBy("text_key", "rule", "alternative", "trigrams")
    met = met.agg(F.size(F.collect_set("trigram")).alias("found"))
    return met.where("found = trigrams").groupBy("text_key").agg(F.collect_set("rule").alias("rules"))


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, kind, place>> of the rule's matches, in code points, end exclusive."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    # what stands between the matches gives their places
    between = F.split(text, rule.pattern, -1)
    pieces = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(part, F.length).alias("counted"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,ok:boolean>>").alias("found"))

    def step(state: Column, piece: Column) -> Column:
        begin = state["at"] + piece["gap"]
        end = begin + F.coalesce(piece["size"], F.lit(0))
        span = F.struct(begin.alias("start"), end.alias("end"), F.coalesce(piece["counted"] >= rule.least, F.lit(False)).alias("ok"))
        return F.struct(end.alias("at"), F.array_append(state["found"], span).alias("found"))

    found = F.filter(F.aggregate(pieces, start, step)["found"], lambda x: x["ok"] & (x["end"] > x["start"]))
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(RULES.index(rule)).alias("place"), x["end"].alias("end"), F.lit(rule.kind).alias("kind")))


def find_secrets(docs: DataFrame, carry: tuple[str, ...] = (), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs``' doc_id, ``text``, the columns of ``carry`` and ``found``: all spans, by start and kind.

    A null text counts as empty and has no spans. Repeated rows have equal results, and so have
    equal texts. Texts of any length are matched whole. An empty table gives an empty result.
    Only the columns doc_id, text and those of ``carry`` are read.
    """
    wanted = materialize(candidates(docs, rules))
    wanted = broadcast_if_small(wanted)
    rows = docs.select("doc_id", "text", *carry).withColumn("_key", text_key(F.col("doc_id"), F.col("text")))
    rows = rows.join(wanted.select(F.col("text_key").alias("_key"), F.col("rules").alias("_rules")), "_key", "left")
    empty = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
    each = []
    for rule in rules:
        indexed = all(trigram_query(rule.pattern))
        may = F.array_contains("_rules", rule.kind) if indexed else F.col("text").rlike(rule.pattern)
        each.append(F.coalesce(F.when(may, spans(F.col("text"), rule)), empty))
    return rows.select("doc_id", "text", *carry, F.array_sort(F.concat(*each)).alias("found"))


def spans_text(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans for each row of ``docs``; see ``find_secrets``."""
    found = find_secrets(docs)
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    base = spans_text(F.filter("found", lambda x: x["place"] < len(BASE)))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in BASE], F.sha2(base, 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"))


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark``.

    Overlapping spans are replaced as one. Texts without secrets, null texts and all other columns
    stay as they are.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(F.col("text"), state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        new = F.when(span["start"] >= state["at"], F.concat(state["text"], gap, F.lit(mark))).otherwise(state["text"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), new.alias("text"))

    clean = F.aggregate("found", start, step, lambda s: F.concat(s["text"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    new = F.when(F.size("found") > 0, clean).otherwise(F.col("text"))
    return with_rest(docs, lambda d, rest: find_secrets(d, rest).withColumn("text", new))
