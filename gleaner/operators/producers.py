"""Generated texts of findings: what is asked for, asking once, and what is made of the answers.

Every text has a producer and a key; findings of one kind share both, so a text is asked for once
whatever the number of findings. Answers are kept in a versioned store. A run takes a lease on the keys
that it is going to ask for, so that runs at the same time ask for different ones; a lease that is not
given back ends by itself. A prompt without an answer is tried again a few times, and what then fails,
or cites what it may not, or lacks a section, is kept apart with its reason and asked for in a later run.

Texts depend on one another in two waves: those on candidates and rules first, then the aims of tests,
which take the requirements that the first ones wrote.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators import cache, plan, prompts
from gleaner.operators.store import KeyedStore
from gleaner.storage import keep

KBS = ("cwe", "iec", "cra")
KEY = ["producer", "cache_key"]
#: How often a prompt is asked at most, and how many seconds a lease lasts.
ATTEMPTS, LEASE_S = 2, 900
#: Answers that are broadcast to the findings; beyond it findings are dealt by key and salt.
BROADCAST_ANSWERS, SALTS = 100_000, 64

Ask = Callable[[str], str | None]


@dataclass(frozen=True)
class Stores:
    """Answers, leases and failures."""

    answers: KeyedStore
    leases: KeyedStore
    failures: KeyedStore


def open_stores(spark: SparkSession, path: str, buckets: int = 16) -> Stores:
    lease, failure = "producer string, cache_key string, owner string, until double", "producer string, cache_key string, reason string, tries int"
    return Stores(cache.open_store(spark, f"{path}/answers", buckets), KeyedStore(spark, f"{path}/leases", lease, KEY, 1), KeyedStore(spark, f"{path}/failures", failure, KEY, 1))


def _request(slot: Column, producer: str, key: Column, prompt: Column, allowed: Column | None = None, when: Column | None = None) -> Column:
    none = F.lit(None).cast("array<string>")
    made = F.struct(slot.alias("slot"), F.lit(producer).alias("producer"), key.alias("cache_key"), prompt.alias("prompt"), (none if allowed is None else allowed).alias("allowed"))
    return made if when is None else F.when(when, made)


#: What the first wave's prompts and keys take of a finding, beside its candidates.
ASKED_OF = ("status", "category", "source", "title", "target", "severity", "detail", "weakness_reason", "recommendation", "iec_reference", "cra_reference")


def kinds(findings: DataFrame) -> DataFrame:
    """One finding of each that the first wave's prompts cannot tell apart, the least by finding_id.

    They are told apart by what goes into a prompt, candidates' texts by a digest, so no text is moved.
    """
    told = [F.col(c) for c in ASKED_OF if c in findings.columns]
    listed = lambda kb: F.transform(F.col(f"rag.{kb}"), lambda c: F.struct(c["key"], c["title"], F.sha2(c["text"], 256)))
    digest = F.sha2(F.to_json(F.struct(*[listed(kb) for kb in KBS])), 256).alias("_digest")
    least = findings.select("finding_id", *told, digest).groupBy(*told, "_digest").agg(F.min("finding_id").alias("finding_id"))
    return findings.join(keep(least.select("finding_id")), "finding_id", "left_semi")


def without_texts(rag: Column) -> Column:
    """Candidates without the texts that prompts were made of; keys, scores and titles stay."""
    return F.when(rag.isNotNull(), F.struct(*[F.transform(rag[kb], lambda c: c.withField("text", F.lit(None).cast("string"))).alias(kb) for kb in KBS]))


def requests(findings: DataFrame, clauses: DataFrame | None = None, prompts_too: bool = True) -> DataFrame:
    """(finding_id, slot, producer, cache_key, prompt, allowed): the texts of the first wave.

    ``findings`` are classified and have rag and detail; ``clauses`` (clause, body) has the texts of
    clause numbers. A finding to review has a text for each candidate and a summary of the first ones; a
    matched one has a name, and advice if it refers to any clause. Without ``prompts_too`` the prompts are
    null, for looking texts up.
    """
    signature = tx.finding_signature(F.col("category"), F.col("source"), F.col("title"))
    review, matched = F.col("status") == "needs_review", F.col("status") == "matched"
    first = {kb: F.try_element_at(F.col(f"rag.{kb}"), F.lit(1)) for kb in KBS}
    rows = _with_clause_texts(findings, clauses if prompts_too else None)
    told = lambda prompt: prompt if prompts_too else F.lit(None).cast("string")

    def of_kb(kb: str) -> Column:
        reference = lambda c: F.concat_ws("\n", F.concat(F.lit("# Reference: "), c["key"], F.lit(" — "), F.coalesce(c["title"], F.lit(""))), F.left(F.coalesce(c["text"], F.lit("")), F.lit(tx.CLAUSE_CHARS)))
        return F.transform(F.col(f"rag.{kb}"), lambda c, i: _request(F.concat(F.lit(kb), i.cast("string")), kb, cache.clause_key_of(c["key"], signature), told(prompts.remediation_prompt(reference(c)))))

    keys = {kb: first[kb]["key"] for kb in KBS}
    summary = _request(F.lit("summary"), "summary", cache.summary_key(signature, *keys.values()), told(prompts.summary_prompt(*first.values())))
    iec, cra = tx.reference_id(F.col("iec_reference")), tx.reference_id(F.col("cra_reference"))
    blocks = [prompts.clause_block(heading, F.col(reference), F.col(body)) for heading, reference, body in (("Component requirement", "iec_reference", "iec_body"), ("Regulation", "cra_reference", "cra_body"))]
    allowed = F.transform(F.filter(F.array(iec, cra), lambda x: x != ""), tx.clause_key)
    rule = _request(F.lit("rule"), "rule", cache.rule_key(iec, cra, F.col("weakness_reason"), F.col("recommendation"), signature), told(prompts.rule_prompt(F.col("weakness_reason"), *blocks, F.col("recommendation"))), allowed, F.size(allowed) > 0)
    name = _request(F.lit("name"), "name", signature, told(prompts.name_prompt(F.col("recommendation"), F.col("cra_reference"))))
    of_review = F.concat(*[of_kb(kb) for kb in KBS], F.array(summary))
    wanted = F.when(review, of_review).when(matched, F.array_compact(F.array(rule, name)))
    return rows.select("finding_id", F.explode(wanted).alias("r")).select("finding_id", "r.*")


def _with_clause_texts(findings: DataFrame, clauses: DataFrame | None) -> DataFrame:
    """``findings`` with iec_body and cra_body. References are looked up once each: they come from the rule table."""
    none = F.lit(None).cast("string")
    if clauses is None:
        return findings.withColumns({"iec_body": none, "cra_body": none})
    rows = findings
    for kind in ("iec", "cra"):
        used = findings.filter("status = 'matched'").select(F.col(f"{kind}_reference").alias("reference")).distinct().withColumn("clause", tx.clause_key(tx.reference_id(F.col("reference"))))
        found = keep(used.join(clauses, "clause").select(F.col("reference").alias(f"{kind}_reference"), tx.truncate(F.col("body"), tx.CLAUSE_CHARS, tx.CLAUSE_MARK).alias(f"{kind}_body")))
        rows = rows.join(F.broadcast(found) if found.count() <= BROADCAST_ANSWERS else found, f"{kind}_reference", "left")
    return rows


def objective_requests(rows: DataFrame) -> DataFrame:
    """The second wave: the aim of each planned test. ``rows`` are live findings with requirement (id, text)."""
    prompt = prompts.objective_prompt(F.col("requirement"))
    return rows.select("finding_id", F.lit("objective").alias("slot"), F.lit("objective").alias("producer"), F.left(F.sha1(prompt), F.lit(16)).alias("cache_key"), prompt.alias("prompt"), F.lit(None).cast("array<string>").alias("allowed"))


def generate(missing: DataFrame, ask: Ask, attempts: int = ATTEMPTS) -> DataFrame:
    """(producer, cache_key, allowed, answer, reason, tries) of the prompts, by an injected function.

    It is asked up to ``attempts`` times; an error counts as no answer. A task that Spark runs again asks again.
    """

    def answer(prompt: str) -> tuple[str | None, str | None, int]:
        reason = None
        for n in range(1, attempts + 1):
            try:
                found = ask(prompt)
            except Exception as error:  # noqa: BLE001
                found, reason = None, f"{type(error).__name__}: {error}"
            if found is not None and found.strip():
                return found.strip(), None, n
            reason = reason or "no answer"
        return None, reason, attempts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [answer(p) for p in batch["prompt"]]
            yield batch[["producer", "cache_key", "allowed"]].assign(answer=[m[0] for m in made], reason=[m[1] for m in made], tries=[m[2] for m in made])

    return missing.select(*KEY, "prompt", "allowed").mapInPandas(run, "producer string, cache_key string, allowed array<string>, answer string, reason string, tries int")


def verdict() -> Column:
    """Why an answer is not kept; null for one that is."""
    told = tx.squash_paren_space(F.replace(F.col("answer"), F.lit(" "), F.lit(" ")))
    cited = tx.unsupported_citations(told, F.col("allowed"))
    return (
        F.when(F.col("answer").isNull(), F.col("reason"))
        .when(F.col("allowed").isNotNull() & (F.size(cited) > 0), F.concat(F.lit("cites "), F.array_join(cited, ", ")))
        .when((F.col("producer") == "summary") & tx.summary(F.col("answer")).isNull(), F.lit("a section lacks"))
    )


def fill(wanted: DataFrame, stores: Stores, ask: Ask, attempts: int = ATTEMPTS, lease_s: float = LEASE_S, wait_s: float = 0.0, owner: str | None = None) -> None:
    """Ask for the texts that are neither stored nor leased by another run, and store them.

    Of several prompts with a key the least is asked. With ``wait_s`` the run waits so long for texts
    that other runs have leased.
    """
    owner = owner or uuid.uuid4().hex
    asked = keep(wanted.groupBy(*KEY).agg(F.min(F.struct("prompt", "allowed")).alias("one")).select(*KEY, "one.*"))
    missing = keep(asked.join(stores.answers.matching(asked).select(*KEY), KEY, "left_anti"))
    if not missing.isEmpty():
        now = time.time()
        stores.leases.insert(missing.select(*KEY, F.lit(owner).alias("owner"), F.lit(now + lease_s).alias("until")), F.col("until") < now)
        mine = stores.leases.matching(missing).filter(F.col("owner") == owner).select(*KEY)
        # Another run may have stored an answer and given its lease back since.
        due = missing.join(mine, KEY, "left_semi").join(stores.answers.matching(missing).select(*KEY), KEY, "left_anti")
        # Written once, so later actions and retries don't ask again.
        made = keep(generate(due, ask, attempts).withColumn("verdict", verdict()))
        stores.answers.upsert(made.filter("verdict IS NULL").select(*KEY, "answer"))
        stores.failures.remove(made.filter("verdict IS NULL"))
        stores.failures.upsert(made.filter("verdict IS NOT NULL").select(*KEY, F.col("verdict").alias("reason"), "tries"))
        stores.leases.remove(missing.join(mine, KEY, "left_semi"))
        end = time.time() + wait_s
        while time.time() < end and not stores.leases.matching(missing).filter(F.col("until") >= time.time()).isEmpty():
            time.sleep(1)


def answered(wanted: DataFrame, stores: Stores) -> DataFrame:
    """(finding_id, texts): the stored answers of each finding, by slot."""
    keyed = wanted.select("finding_id", "slot", *KEY)
    found = stores.answers.matching(keyed)
    if found.count() <= BROADCAST_ANSWERS:
        told = keyed.join(F.broadcast(found), KEY)
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        told = keyed.withColumn("salt", F.pmod(F.xxhash64("finding_id"), F.lit(SALTS)).cast("int")).join(salted, [*KEY, "salt"])
    # A handful of texts a finding.
    return told.groupBy("finding_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "answer"))).alias("texts"))


def with_texts(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """``findings`` with the generated texts in their places, and what a report falls back on where one lacks.

    Candidates get text_zh, findings to review summary; a matched finding's advice takes the place of
    its rule's, recommendation_source tells whose it is, and weakness_name names it.
    """
    rows = findings.join(texts, "finding_id", "left")
    text = lambda slot: F.try_element_at("texts", slot)
    matched = F.col("status") == "matched"
    rag = F.struct(*[_texts_of(kb, text).alias(kb) for kb in KBS])
    advice = F.when(matched, text(F.lit("rule")))
    out = rows.withColumns({"rag": rag, "summary": F.when(F.col("status") == "needs_review", tx.summary(text(F.lit("summary")))), "advice": advice, "weakness_name": F.when(matched, text(F.lit("name")))})
    made = F.col("advice").isNotNull()
    return out.withColumns({"recommendation_source": F.when(made, "llm").when(matched, "rule"), "recommendation": F.when(made, F.col("advice")).otherwise(F.col("recommendation"))}).drop("advice", "texts")


def _texts_of(kb: str, text: Callable[[Column], Column]) -> Column:
    def told(candidate: Column, i: Column) -> Column:
        return candidate.withField("text_zh", text(F.concat(F.lit(kb), i.cast("string"))))

    return F.transform(F.col(f"rag.{kb}"), told)


def first_wave(findings: DataFrame, stores: Stores, ask: Ask | None, clauses: DataFrame | None = None, **limits) -> DataFrame:
    """``findings`` with the texts on candidates and rules; without ``ask`` with those that are stored.

    Prompts are made of one finding a kind; every finding then looks its texts up by key.
    """
    if ask is not None:
        fill(requests(kinds(findings), clauses), stores, ask, **limits)
    return with_texts(findings, answered(requests(findings, prompts_too=False), stores))


def test_plan(findings: DataFrame, stores: Stores, ask: Ask | None, **limits) -> DataFrame:
    """Plan rows of the live findings, their aims generated from the requirements that the first wave wrote."""
    rows = findings.withColumns({"clauses": F.col("rag.iec"), "articles": F.col("rag.cra")})
    basis = plan.requirement(F.col("status"), F.col("cra_reference"), F.col("clauses"), F.col("articles"), F.col("recommendation"))
    live = rows.filter(plan.is_live(F.col("category"), F.col("target"))).withColumn("requirement", basis)
    wanted = objective_requests(live)
    if ask is not None:
        fill(wanted, stores, ask, **limits)
    made = answered(wanted, stores).select("finding_id", F.try_element_at("texts", F.lit("objective")).alias("objective"))
    return plan.test_plan(rows, made)
