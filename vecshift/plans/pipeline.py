"""A whole migration: measured on a sample, gated, carried out in batches, verified, and undone if need be.

The driver walks through the states; every step on records is a DataFrame plan. What a resumed run needs is in the
checkpoint (facts, the cursor, the fitted strategy) and in the target store's log or, for stores without one, in a ledger of
what each batch wrote and replaced; nothing grows with the collection but the collection and its ledger.
"""

from __future__ import annotations

import shutil
import time
from dataclasses import asdict
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecshift.functions.redaction import redact
from vecshift.functions.staging import checkpoint
from vecshift.functions.vectors import has_vector, is_usable, renormalize
from vecshift.operators import compat, knn, migrate, ranking, selection, stats
from vecshift.operators.transforms import Affine
from vecshift.plans.embed import Embedder, HashEmbedder
from vecshift.plans.state import FAILED, STATES, Checkpoints, Request, Result, record, start
from vecshift.plans.strategies import BY_NAME, Facts, candidates, fitted
from vecshift.sources.contract import Store

#: Records of a discovery sample, of the benchmark's sample, its queries, and of the verification's sample.
DISCOVERY, SAMPLE, QUERIES, VERIFY = 200, 400, 40, 100
TOP_K = 10


class NeedsApproval(Exception):
    """The chosen strategy has not been approved."""


class Migration:
    def __init__(self, spark: SparkSession, request: Request, source: Store, target: Store, folder: str, embedder: Embedder | None = None, golden: DataFrame | None = None):
        """golden: ``query_id, vector, expected_ids`` to verify with; optional."""
        self.spark, self.request, self.source, self.target = spark, request, source, target
        self.checkpoints, self.folder = Checkpoints(folder), Path(folder)
        self.embedder, self.golden = embedder, golden
        self.state: dict = {}
        self._sample: DataFrame | None = None
        self._function = None

    # -- the walk --

    def run(self) -> Result:
        self.state = start(self.request, self.checkpoints)
        try:
            while self.state["next_state"] != "DONE":
                name = self.state["next_state"]
                detail = getattr(self, "_" + name.lower())()
                after = "DONE" if name == "COMPLETE" else STATES[STATES.index(name) + 1]
                record(self.state, name, detail, after)
                self.checkpoints.save(self.request.migration_id, self.state)
        except NeedsApproval as wait:
            self.checkpoints.save(self.request.migration_id, self.state)
            return Result(self.request.migration_id, "APPROVAL", "waiting", str(wait), self.approval())
        except Exception as error:
            record(self.state, FAILED, str(error)[:2000], self.state["next_state"])
            self.checkpoints.save(self.request.migration_id, self.state)
            return Result(self.request.migration_id, FAILED, "failed", str(error))
        return Result(self.request.migration_id, "COMPLETE", "success", report=self.report())

    def _load(self) -> Migration:
        """With the kept state, to look at or go on from."""
        self.state = self.checkpoints.load(self.request.migration_id) or {}
        return self

    def _init(self):
        return {}

    def _connect(self):
        states = {"source": self.source.validate(), "target": self.target.validate()}
        if not all(states.values()):
            raise RuntimeError(f"connection failed: {[k for k, v in states.items() if not v]}")
        return states

    def _discover(self):
        info = self.source.info(self.request.source_resource, self.request.namespace)
        there = self.target.info(self.request.target_resource, self.request.namespace)
        sample = self.source.sample(self.request.source_resource, DISCOVERY, self.request.namespace)
        norms = stats.normalization(sample).first()
        identity = compat.embedding_identity(self.request.embedding_provider, self.request.embedding_model, norms is not None and norms["confidence"] is not None)
        found = {"source": asdict(info), "target": asdict(there), "normalization": norms["status"] if norms else "unknown", "embedding": identity}
        self.state["discovery"] = found
        return found

    def _normalize(self):
        """The facts in a form that doesn't depend on the stores."""
        d = self.state["discovery"]
        target = self.request.target_dimension or d["target"]["dimension"] or d["source"]["dimension"]
        metric = d["target"]["metric"] if d["target"]["metric"] != "unknown" else d["source"]["metric"]
        self.state["plan_facts"] = {
            "source_dimension": d["source"]["dimension"], "target_dimension": target, "source_metric": d["source"]["metric"], "target_metric": metric,
            "source_datatype": d["source"]["datatype"], "target_datatype": "float32" if d["target"]["datatype"] in ("unknown", "int8", "binary") else d["target"]["datatype"],
            "quantized": d["source"]["quantized"], "norms": {"detected": "confirmed", "not_normalized": "not_normalized"}.get(d["normalization"], "unknown"),
            "populated": bool(d["target"]["count"]), "space": d["embedding"]["space"],
        }
        return self.state["plan_facts"]

    def _compare(self):
        f = self.state["plan_facts"]
        kinds = "source_dimension int, target_dimension int, source_metric string, target_metric string, source_datatype string, target_datatype string, quantized string, norms string, populated boolean, space string"
        row = self.spark.createDataFrame([tuple(f.values())], kinds)
        c = F.col
        classes = {
            "dimension": compat.dimension(c("source_dimension"), c("target_dimension")),
            "datatype": compat.datatype(c("source_datatype"), c("target_datatype"), c("quantized")),
            "metric": compat.metric(c("source_metric"), c("target_metric"), c("norms")),
            "vector_type": compat.vector_type(F.lit("dense"), F.lit("dense")),
            "quantization": compat.quantization(c("quantized")),
            "semantic_space": compat.semantic_space(c("populated"), c("space"), c("space")),
        }
        self.state["compatibility"] = row.select(*[v.alias(k) for k, v in classes.items()]).first().asDict()
        return self.state["compatibility"]

    def _plan(self):
        f = self.state["plan_facts"]
        facts = Facts(f["source_dimension"], f["target_dimension"], self.state["compatibility"], self.request.embedding_model, bool(self.request.document_field and self.embedder))
        self.state["candidates"] = candidates(facts)
        return {"possible": [c["strategy"] for c in self.state["candidates"] if c["status"] == "possible"]}

    def sample(self) -> DataFrame:
        """The benchmark's sample: ``id, vector[, text], is_query``, dequantised, read once."""
        if self._sample is None:
            self._sample = checkpoint(migrate.dry_run(self._read(), SAMPLE, QUERIES))
        return self._sample

    def _read(self) -> DataFrame:
        return self._usable(self.source.read(self.request.source_resource, self.request.namespace))

    def _usable(self, rows: DataFrame) -> DataFrame:
        """Records with a vector, dequantised, with the text that strategies may need."""
        rows = rows.where(has_vector(F.col("vector")))
        kind = self.state["plan_facts"]["source_datatype"]
        if kind in ("int8", "binary"):
            from vecshift.functions.vectors import dequantize

            rows = rows.withColumn("vector", dequantize(F.col("vector"), kind).cast("array<float>"))
        if self.request.document_field:
            rows = rows.withColumn("text", F.get_json_object("payload", f"$.{self.request.document_field}"))
        return rows

    def _dry_run(self):
        counts = self.sample().agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).first()
        return {"sample": counts["n"], "queries": counts["q"]}

    def _metric(self) -> str:
        metric = self.state["plan_facts"]["target_metric"]
        return metric if metric in knn.METRICS else "cosine"

    def evaluate(self, strategy: str) -> dict:
        """One row of results; a strategy that can't be carried out fails, and says why."""
        base = {"benchmark_id": f"{self.request.migration_id}-{strategy}", "strategy": strategy}
        try:
            sample = self.sample()
            function = fitted(strategy, sample, self.state["plan_facts"]["target_dimension"], "text" if self.request.document_field else None, self.embedder)
            moved = checkpoint(function(sample).where(has_vector(F.col("vector"))))
            spread, bad = stats.distribution(moved).first(), stats.fidelity(moved).first()
            if bad["rejected"] or not spread["count"]:
                return base | {"passed": False, "reasons": [f"vectors are not finite: has_nan={spread['has_nan']} has_inf={spread['has_inf']}" if spread["count"] else "no vectors"]}
            metric = self._metric()
            source, before = self._timed(sample, metric)
            target, after = self._timed(moved, metric)
            r = self.request
            slower = 100.0 * (after - before) / max(before, 1e-9)
            row = ranking.gate(ranking.equivalence(ranking.per_query(source, target, TOP_K)), r.minimum_recall, r.minimum_ndcg, r.maximum_overlap_drop, F.lit(slower), r.maximum_latency_percent).first().asDict()
            # texts embedded anew are what a strategy costs; a float has four bytes
            texts = sample.where("trim(text) <> ''").count() if strategy == "re_embedding" else 0
            measured = {"cost": float(texts), "latency_ms": 1000 * after / max(QUERIES, 1), "latency_percent": slower, "storage_bytes": 4.0 * (spread["dimension"] or 0) * spread["count"]}
            return base | measured | {k: row[k] for k in ("sample_size", "recall_at_k", "ndcg_at_k", "topk_overlap", "mrr", "rank_correlation", "score_drift", "passed", "reasons")}
        except Exception as error:
            return base | {"passed": False, "reasons": [f"{type(error).__name__}: {str(error)[:300]}"]}

    def _timed(self, rows: DataFrame, metric: str) -> tuple[DataFrame, float]:
        """The ranking of the sample's queries, and the seconds it took."""
        began = time.monotonic()
        return checkpoint(knn.knn(rows, rows.where("is_query"), TOP_K, metric)), time.monotonic() - began

    def _benchmark(self):
        names = [c["strategy"] for c in self.state["candidates"] if c["status"] == "possible"]
        self.state["results"] = [self.evaluate(n) for n in names]
        measures = ("cost", "latency_ms", "storage_bytes")
        rows = [(r["benchmark_id"], r["strategy"], bool(r["passed"]), float(r.get("recall_at_k") or 0.0), *(float(r.get(m) or 0.0) for m in measures)) for r in self.state["results"]]
        table = self.spark.createDataFrame(rows, "benchmark_id string, strategy string, passed_quality_gate boolean, quality double, cost double, latency_ms double, storage_bytes double")
        chosen = selection.select(table, weights=self.request.weights).first()
        if chosen is None:
            raise RuntimeError(f"no candidate passed the gate: { {r['strategy']: r['reasons'] for r in self.state['results']} }")
        selection.require_executed(chosen["benchmark_id"], table)
        self.state["selected"] = chosen.asDict()
        return self.state["selected"]

    def _approval(self):
        summary = self.approval()
        if self.request.needs_approval and self.state.get("approved") != self.state["selected"]["benchmark_id"]:
            raise NeedsApproval(f"{summary['strategy']} waits for approval" if self.state.get("approved") is None else f"{summary['strategy']} was refused")
        return summary

    def approve(self, benchmark_id: str | None) -> None:
        """Approve the chosen result by its id, or refuse it (null); a resumed run goes on if it is the chosen one."""
        self._load()
        results = [r["benchmark_id"] for r in self.state.get("results", [])]
        if benchmark_id is not None and benchmark_id not in results:
            raise ValueError(f"no benchmark {benchmark_id!r} was run")
        self.state["approved"] = benchmark_id if benchmark_id is not None else ""
        self.checkpoints.save(self.request.migration_id, self.state)

    def approval(self) -> dict:
        """What there is to approve."""
        if not self.state.get("selected"):
            return {"ready": False, "reason": "no strategy has been selected"}
        best = self.selected_result()
        return {"ready": True, "benchmark_id": best["benchmark_id"], "sample": best["sample_size"], "strategy": best["strategy"], "recall": round(best["recall_at_k"], 4), "ndcg": round(best["ndcg_at_k"], 4), "overlap": round(best["topk_overlap"], 4), "is_stub": BY_NAME[best["strategy"]].is_stub}

    def selected_result(self) -> dict:
        return next(r for r in self.state["results"] if r["benchmark_id"] == self.state["selected"]["benchmark_id"])

    def function(self):
        """The chosen strategy. It is fitted once, on the sample; an affine map is kept beside the checkpoint with its checksum, so
        that a resumed run applies the same map although the source may have changed since."""
        if self._function is None:
            kept, fits = self.state.get("fit"), Checkpoints(self.folder / "fits")
            if kept:
                fit = Affine.from_json((fits.load(self.request.migration_id) or {"fit": "{}"})["fit"])
                if fit.checksum() != kept["checksum"]:
                    raise RuntimeError("the kept fit is not the one that was made")
                self._function = fit.apply
            else:
                self._function = fitted(self.state["selected"]["strategy"], self.sample(), self.state["plan_facts"]["target_dimension"], "text" if self.request.document_field else None, self.embedder)
                fit = getattr(self._function, "__self__", None)
                if isinstance(fit, Affine):
                    fits.save(self.request.migration_id, {"request": {"migration_id": self.request.migration_id}, "fit": fit.to_json()})
                    self.state["fit"] = {"strategy": fit.strategy, "checksum": fit.checksum()} | fit.report
                    self.checkpoints.save(self.request.migration_id, self.state)
        return self._function

    def transformed(self, rows: DataFrame) -> DataFrame:
        moved = self.function()(rows).where(has_vector(F.col("vector")))
        if self.state["discovery"]["normalization"] == "unknown" and self.state["plan_facts"]["target_metric"] == "cosine":
            moved = moved.withColumn("vector", renormalize(F.col("vector")).cast("array<float>"))
        return moved

    def _migrate(self):
        """Copy, page by page or all at once. Each page is a batch, written down before it is written out: a run that broke off
        goes on at its cursor and writes the open batch again, which changes nothing that was right."""
        r, work = self.request, self.state.setdefault("migrate", {"cursor": None, "done": False, "open": None, "batches": []})
        while not work["done"]:
            if r.page_records:
                rows, cursor = self.source.scan(r.source_resource, r.page_records, work["cursor"], r.namespace)
                read = rows.count()
            else:
                rows, cursor, read = self.source.read(r.source_resource, r.namespace), None, None
            if work["open"] is None:
                number = self.target.reserve(r.target_resource, r.migration_id) if self._logged() else len(work["batches"]) + 1
                work["open"] = number
                self.checkpoints.save(r.migration_id, self.state)
            written = self._write(self.transformed(self._usable(rows)), work["open"])
            work["batches"].append({"batch": work["open"], "vectors_read": written if read is None else read, "vectors_written": written})
            work |= {"open": None, "cursor": cursor, "done": cursor is None}
            self.checkpoints.save(r.migration_id, self.state)
        self.state["written"] = sum(b["vectors_written"] for b in work["batches"])
        return {"vectors_written": self.state["written"], "batches": len(work["batches"])}

    def _logged(self) -> bool:
        """Whether the target keeps a log of batches, which can be undone; for others this migration keeps a ledger."""
        return hasattr(self.target, "undo")

    def _ledger(self, batch: int) -> str:
        return f"file://{self.folder.resolve()}/ledger/{self.checkpoints.path(self.request.migration_id).stem}/batch={batch}"

    def entries(self) -> DataFrame | None:
        """The ledger: ``(migration_id, batch, id, existed, before)`` of all batches, the open one among them."""
        work = self.state.get("migrate") or {"batches": [], "open": None}
        numbers = [b["batch"] for b in work["batches"]] + ([work["open"]] if work["open"] else [])
        kept = [self._ledger(n) for n in numbers if Path(self._ledger(n)[7:], "_SUCCESS").exists()]
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(p) for p in kept]) if kept else None

    def _write(self, rows: DataFrame, batch: int) -> int:
        r = self.request
        rows = checkpoint(rows)
        if self._logged():
            if r.id_collision_policy != "overwrite":
                own = [b["batch"] for b in self.state["migrate"]["batches"]] + [batch]
                written = self.target.log(r.target_resource).where(F.col("batch").isin(own)).select("id")
                rows = migrate.resolve(rows, self.target.read(r.target_resource, r.namespace), r.id_collision_policy, "id", written)
            return self.target.upsert(r.target_resource, rows, batch, r.namespace, owner=r.migration_id)
        known = self.entries()
        written = None if known is None else known.where("not existed").select("id")
        there = checkpoint(self.target.fetch(r.target_resource, rows.select("id"), r.namespace))
        rows = checkpoint(migrate.resolve(rows, there, r.id_collision_policy, "id", written))
        path = self._ledger(batch)
        if not Path(path[7:], "_SUCCESS").exists():  # else the open batch is written again: what it replaced is known
            before = there if r.id_collision_policy == "overwrite" else self.target.fetch(r.target_resource, rows.select("id"), r.namespace)
            migrate.ledger(before, rows, r.migration_id, batch).write.mode("overwrite").parquet(path)
        return self.target.upsert(r.target_resource, rows, batch, r.namespace)

    def progress(self) -> DataFrame:
        """``(batch, vectors_read, vectors_written, total_read, total_written)`` of the batches written so far."""
        work = self.state.get("migrate") or {"batches": []}
        rows = self.spark.createDataFrame([(b["batch"], b["vectors_read"], b["vectors_written"]) for b in work["batches"]], "batch bigint, vectors_read bigint, vectors_written bigint")
        return migrate.totals(rows)

    def _cdc_sync(self):
        return {"note": "changes are followed by streaming.sync, not by the migration"}

    def _verify(self):
        target = self.target.read(self.request.target_resource, self.request.namespace)
        found: dict = {}
        if self.state["selected"]["strategy"] == "direct_copy":
            rows = migrate.page(self._read(), None, VERIFY)
            found["integrity"] = stats.integrity(rows, target).first().asDict()
        if self.golden is None:
            found["retrieval"] = "not measured: no golden queries"
        else:
            queries = self.golden.select(F.col("query_id").cast("string").alias("id"), "vector", "expected_ids")
            moved = checkpoint(self.transformed(queries.withColumn("text", F.lit(None).cast("string"))))
            ranked = knn.knn(target.where(is_usable(F.col("vector"))), moved, TOP_K, self._metric())
            before = knn.knn(self._read(), queries, TOP_K, self._metric())
            expected = queries.select(F.col("id").alias("query_id"), F.explode("expected_ids").alias("id"))
            r = self.request
            gated = ranking.gate(ranking.equivalence(ranking.per_query(before, ranked, TOP_K)), r.minimum_recall, r.minimum_ndcg, r.maximum_overlap_drop)
            found["retrieval"] = gated.first().asDict()
            found["expected_id_recall"] = ranking.expected_recall(expected, ranked, TOP_K).agg(F.avg("expected_id_recall")).first()[0]
        self.state["validation"] = found
        found["mode"] = stats.validation_mode(self.golden is not None, self.embedder is not None, self.request.document_field is not None)
        if self.request.verification_blocks:
            if found.get("integrity", {}).get("within_tolerance") is False:
                raise RuntimeError(f"the copy differs from its source: {found['integrity']}")
            if self.golden is not None and not found["retrieval"]["passed"]:
                raise RuntimeError(f"golden queries fail the gate: {found['retrieval']['reasons']}")
        return found

    def _cutover(self):
        return {}

    def _complete(self):
        """Write the provenance and the report beside the checkpoint."""
        best = self.selected_result()
        integrity = self.state["validation"].get("integrity", {}).get("within_tolerance")
        parts = [best["recall_at_k"], best["ndcg_at_k"], best["topk_overlap"], self.state["validation"].get("expected_id_recall")] + ([1.0 if integrity else 0.0] if integrity is not None else [])
        known = [p for p in parts if p is not None]
        self.state["provenance"] = {
            "migration_id": self.request.migration_id, "source": self.request.source_resource, "target": self.request.target_resource, "strategy": best["strategy"],
            "input_dimension": self.state["plan_facts"]["source_dimension"], "output_dimension": self.state["plan_facts"]["target_dimension"], "semantic_space": self.state["plan_facts"]["space"],
            "benchmark_id": best["benchmark_id"], "gate_passed": best["passed"], "fit": self.state.get("fit"), "confidence": sum(known) / len(known) if known else None,
        }
        reports = Checkpoints(self.folder / "reports")
        return {"report": str(reports.save(self.request.migration_id, self.report()))}

    def report(self) -> dict:
        """Everything kept, without secrets."""
        keys = ("history", "compatibility", "candidates", "results", "selected", "approved", "written", "migrate", "validation", "provenance")
        return redact({"migration_id": self.request.migration_id} | {k: self.state.get(k) for k in keys})

    def rollback(self) -> int:
        """Undo exactly what this migration wrote, in any store: written records are removed, the records they replaced are back
        as they were, others are untouched. Returns the number of batches undone."""
        self._load()
        work = self.state.get("migrate")
        numbers = ([b["batch"] for b in work["batches"]] + ([work["open"]] if work["open"] else [])) if work else []
        if not numbers:
            return 0
        name, space = self.request.target_resource, self.request.namespace
        if self._logged():
            self.target.undo(name, numbers)
        elif (entries := self.entries()) is not None:
            first = checkpoint(entries.groupBy("id").agg(F.min_by(F.struct("existed", "before"), "batch").alias("first")).select("id", "first.*"))
            back = first.where("existed").select("before.*")
            if not back.isEmpty():
                self.target.upsert(name, back, 0, space)
            self.target.delete(name, first.where("not existed").select("id"), 0, space)
        record(self.state, "ROLLBACK", {"batches": numbers}, "MIGRATE")
        for n in numbers:
            shutil.rmtree(self._ledger(n)[7:], ignore_errors=True)
        for kept in ("written", "migrate"):
            self.state.pop(kept, None)
        self.checkpoints.save(self.request.migration_id, self.state)
        return len(numbers)


def offline_embedder(dimension: int) -> Embedder:
    return HashEmbedder(dimension)
