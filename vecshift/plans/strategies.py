"""The strategies a plan can choose among: when each applies, and how it is fitted."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecshift.functions.staging import checkpoint
from vecshift.functions.vectors import truncated
from vecshift.operators import transforms
from vecshift.operators.compat import MRL_DIMENSIONS
from vecshift.plans.embed import Embedder, embed

POSSIBLE, IMPOSSIBLE = "possible", "impossible"


@dataclass(frozen=True)
class Facts:
    """What is known when a plan is made. ``classes``: property -> class, as ``compat`` gives them."""

    source_dimension: int | None
    target_dimension: int | None
    classes: dict[str, str] = field(default_factory=dict)
    model: str | None = None
    documents: bool = False
    historical_queries: bool = False
    #: Whether an unknown or other semantic space keeps vectors from being copied as they are.
    strict_space: bool = True


@dataclass(frozen=True)
class Strategy:
    """applies: (facts) -> (possible, reason). fit: (sample with ``vector`` and, for calibration, ``target``; target dimension)
    -> a function on DataFrames."""

    name: str
    applies: Callable[[Facts], tuple[bool, str]]
    fit: Callable[[DataFrame, int], Callable[[DataFrame], DataFrame]]
    is_stub: bool = False
    needs_pairs: bool = False


def _affine(fit):
    return lambda sample, target: fit(sample, target).apply


def _direct(f: Facts):
    needed = ("dimension", "datatype", "metric", "vector_type", *(("semantic_space",) if f.strict_space else ()))
    bad = [p for p in needed if f.classes.get(p) not in ("exact", "compatible")]
    return not bad, "all properties fit" if not bad else f"{', '.join(bad)}: not exact or compatible"


def _mrl(f: Facts):
    known = MRL_DIMENSIONS.get(f.model or "", ())
    good = f.target_dimension in known and bool(f.source_dimension) and f.target_dimension < f.source_dimension
    return good, f"{f.model} may be cut to {f.target_dimension}" if good else "the model is not known to keep its meaning at that dimension"


def _smaller(f: Facts):
    good = bool(f.source_dimension and f.target_dimension and f.target_dimension < f.source_dimension)
    return good, "the target is smaller" if good else "dimensions unknown or the target is not smaller"


def _both(f: Facts):
    good = bool(f.source_dimension and f.target_dimension)
    return good, "both dimensions are known" if good else "a dimension is unknown"


def _documents(f: Facts):
    return f.documents, "documents are there" if f.documents else "no documents to embed again"


def _square(f: Facts):
    good = f.documents and f.source_dimension is not None and f.source_dimension == f.target_dimension
    return good, "documents and equal dimensions" if good else "needs documents and equal dimensions"


def _vec2vec(f: Facts):
    good = not f.model and not f.documents and not f.historical_queries
    return good, "nothing else is known of the space" if good else "the model, documents or queries are known"


def _stub(name: str, applies, need: str) -> Strategy:
    def fit(sample, target):
        raise NotImplementedError(f"{name}: {need}")

    return Strategy(name, applies, fit, is_stub=True)


STRATEGIES = (
    Strategy("direct_copy", _direct, lambda sample, target: lambda df: df),
    Strategy("mrl", _mrl, lambda sample, target: lambda df: df.withColumn("vector", truncated(F.col("vector"), target).cast("array<float>"))),
    Strategy("pca", _smaller, _affine(lambda s, t: transforms.fit_pca(s, t))),
    Strategy("random_projection", _both, _affine(lambda s, t: transforms.fit_random_projection(s.select(F.max(F.size("vector"))).first()[0], t))),
    Strategy("ridge_mapping", _documents, _affine(lambda s, t: transforms.fit_ridge(s)), needs_pairs=True),
    Strategy("procrustes_mapping", _square, _affine(lambda s, t: transforms.fit_procrustes(s)), needs_pairs=True),
    Strategy("procrustes_diag_mapping", _square, _affine(lambda s, t: transforms.fit_procrustes_diagonal(s)), needs_pairs=True),
    Strategy("low_rank_affine_mapping", _documents, _affine(lambda s, t: transforms.fit_low_rank(s)), needs_pairs=True),
    Strategy("re_embedding", _documents, lambda sample, target: None),
    _stub("residual_mlp_mapping", _documents, "a trained network, of some thousand pairs"),
    _stub("matryoshka_adaptor", _smaller, "a trained adaptor, of at least 5000 pairs"),
    _stub("learned_projection", _smaller, "a trained projection, of at least 5000 pairs"),
    _stub("retrieval_aware_projection", _smaller, "a trained projection, of at least 10000 pairs"),
    _stub("knowledge_distillation", _both, "a trained student, of at least 10000 pairs"),
    _stub("vec2vec", _vec2vec, "a translator trained without pairs; its vectors are approximations and must be disclosed as such"),
    _stub("smec", lambda f: (False, "not available"), "not available"),
)
BY_NAME = {s.name: s for s in STRATEGIES}


def candidates(facts: Facts) -> list[dict]:
    """Every strategy, whether it applies, and why."""
    rows = []
    for s in STRATEGIES:
        possible, reason = s.applies(facts)
        rows.append({"strategy": s.name, "status": POSSIBLE if possible else IMPOSSIBLE, "reason": reason, "is_stub": s.is_stub})
    return rows


def fitted(name: str, sample: DataFrame, target: int, document: str | None = None, embedder: Embedder | None = None) -> Callable[[DataFrame], DataFrame]:
    """The strategy's function on DataFrames with ``vector`` (and, where it needs text, the column ``document``).

    Calibrated strategies learn from the sample's documents, embedded anew, at most MOST_PAIRS of them."""
    strategy = BY_NAME[name]
    if name == "re_embedding" or strategy.needs_pairs:
        if document is None or embedder is None:
            raise ValueError(f"{name} needs documents and an embedder")
    if name == "re_embedding":
        return lambda df: embed(df, document, embedder)
    if strategy.needs_pairs:
        pairs = transforms.calibration_pairs(sample.where(F.trim(document) != ""))
        sample = checkpoint(embed(pairs, document, embedder, "target"))
    return strategy.fit(sample, target)
