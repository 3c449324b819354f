"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.llm import (decontam, digest_index, filter_audit, html_blocks, langid, licenses, line_runs,
                          merkle, mixing, pii, quality, secrets, ship, simhash)
from weekcast.sources.sinks import stage_path
from weekcast.sources.tables import load

for _module in ("common", "decontam", "filter_audit", "html_blocks", "langid", "licenses", "line_runs", "mixing", "quality", "secrets",
                "simhash"):
    ship(f"weekcast.llm.{_module}")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(load(spark, sf_dir, "documents", ["doc_id", "text"]))


@register
def op2_main_text(spark, sf_dir):
    """Main text of every page."""
    pages = load(spark, sf_dir, "pages", ["page_id", "url", "html"])
    return html_blocks.extract(pages, prefix="", keep=["page_id", "url"])


@register
def op3_line_dedup(spark, sf_dir):
    """Every document without the later copies of repeated line runs."""
    docs = load(spark, sf_dir, "documents", ["doc_id", "text"])
    clean, removed = line_runs.dedup_lines(docs)
    return clean.select("doc_id", "text", F.col(removed).alias("n_removed"))


@register
def op4_secrets(spark, sf_dir):
    """Secrets in every document."""
    docs = load(spark, sf_dir, "documents", ["doc_id", "text"])
    return secrets.find_secrets(docs, prefix="").drop("text")


@register
def op5_decontamination(spark, sf_dir):
    """Documents that contain a benchmark item, and the item."""
    return decontam.contaminated(load(spark, sf_dir, "documents", ["doc_id", "text"]),
                                 load(spark, sf_dir, "benchmark"))


@register
def op6_licenses(spark, sf_dir):
    """License phrases and templates in every document."""
    docs = load(spark, sf_dir, "documents", ["doc_id", "text"])
    return licenses.find_licenses(docs, prefix="").drop("text")


@register
def op7_mixing(spark, sf_dir):
    """Words that the mix takes of every document."""
    docs = load(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@register
def op8_language(spark, sf_dir):
    """Predicted language of every document; learned from the rows that are not held out."""
    docs = load(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    held = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.filter(~held & F.col("doc_id").isNotNull()), "text", "lang", "doc_id")
    out = langid.identify(docs.select("doc_id", "text"), model, prefix="")
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "spans")


@register
def op9_pii(spark, sf_dir):
    """Personal data in every document."""
    docs = load(spark, sf_dir, "documents", ["doc_id", "text"])
    marked, p = pii.find_pii(docs)
    return marked.select(
        "doc_id", *[F.size(f"{p}{k}").cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.spans_text(p, pii.KINDS), 256).alias("base_sha256"),
        pii.spans_text(p, (*pii.KINDS, pii.OTHER)).alias("spans"))


@register
def op10_host_quality(spark, sf_dir):
    """Statistics and verdict of every document."""
    docs = load(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    judged = quality.host_quality(docs, carry=["doc_id"])
    names = quality.verdict_names(docs)
    return judged.select("doc_id", *[F.col(names[s]).alias(s) for s in quality.STATS],
                         F.col(names["base_failed"]).alias("base_failed"),
                         F.col(names["kept"]).alias("kept"),
                         F.col(names["host_guilty"]).alias("host_guilty"))


@register
def op11_exact_dedup(spark, sf_dir):
    """Every document with the row that stays of its equal texts, by a new digest index that the
    documents are delivered to."""
    docs = load(spark, sf_dir, "documents", ["doc_id", "text"])
    index = digest_index.DigestIndex.create(spark, stage_path(spark, "digest-index"))
    return digest_index.keep_largest(docs, index).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


MANIFEST_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


@register
def op12_merkle_manifest(spark, sf_dir):
    """Leaf, subroot, root and proof of every document, and the root that its proof gives for
    what was handed in: a fifth of the documents are lower-cased."""
    docs = load(spark, sf_dir, "documents", list(MANIFEST_COLUMNS))
    cols = {c: F.col(c) for c in MANIFEST_COLUMNS}
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = merkle.leaf_digest(cols.values())
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    given = F.when(tampered, merkle.leaf_digest((cols | {"text": lowered}).values())).otherwise(leaf)
    rows = docs.select("doc_id", "source", leaf.alias("leaf"), given.alias("given"))
    manifest = merkle.build(rows, "source", "doc_id", "leaf", carry=["given"])
    proofs = merkle.prove(manifest, manifest.leaves.select("grp", "pos", "ident", "given"), ["ident", "given"])
    folded = proofs.withColumn("folded_root", merkle.fold(F.col("given"), F.col("path")))
    root = F.lit(manifest.root).cast("string")
    return folded.select(F.col("ident").alias("doc_id"), "leaf", "subroot", root.alias("root"),
                         merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == root).alias("verified"))


@register
def op13_filter_audit(spark, sf_dir):
    """What each of five filters removes in every order, by language."""
    docs = load(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    marked, fails, outcomes = filter_audit.corpus_filters(docs, load(spark, sf_dir, "labels"))
    return filter_audit.audit(marked, F.col("part"), fails, outcomes)
