"""Settings of a pipeline: defaults, a YAML file, overrides; checked before anything runs."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace
from itertools import product

from lodestone.operators import chunking, retrieval
from lodestone.sources.corpus import fingerprint, merge


@dataclass(frozen=True)
class Settings:
    """One configuration. ``reranker`` None means none; the gate is off by default."""

    chunker: str = "recursive"
    retriever: str = "hybrid"
    reranker: str | None = None
    top_k: int = 5
    rerank_candidates: int = 20
    embed_model: str = "hash-64"
    chunk_size: int = 800
    chunk_overlap: int = 120
    gate_enabled: bool = False
    gate_min_score: float = 0.45
    gate_min_top_score: float = 0.50

    def __post_init__(self) -> None:
        """All that is wrong, in one error."""
        wrong = [f"{name} must be one of {', '.join(known)}, not {value!r}" for name, value, known in (("chunker", self.chunker, chunking.CHUNKERS), ("retriever", self.retriever, retrieval.RETRIEVERS)) if value not in known]
        whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
        number = lambda v: whole(v) or isinstance(v, float)
        wrong += [f"{n} must be a whole number of at least {low}" for n, low in (("top_k", 1), ("rerank_candidates", 1), ("chunk_size", 1), ("chunk_overlap", 0)) if not (whole(getattr(self, n)) and getattr(self, n) >= low)]
        if not wrong and self.chunk_overlap >= self.chunk_size:
            wrong.append("chunk_overlap must be less than chunk_size")
        if not wrong and self.reranker and self.rerank_candidates < self.top_k:
            wrong.append("rerank_candidates must be at least top_k")
        wrong += [f"{n} must be from -1 to 1" for n in ("gate_min_score", "gate_min_top_score") if not (number(getattr(self, n)) and -1 <= getattr(self, n) <= 1)]
        if wrong:
            raise ValueError("; ".join(wrong))

    @property
    def slug(self) -> str:
        return f"{self.chunker}__{self.retriever}__{self.reranker or 'norerank'}"

    @property
    def collection(self) -> str:
        """What decides an index: the chunker and the embedder, not the retriever."""
        return f"{self.chunker}__{self.embed_model.split('/')[-1].replace('.', '-')}"

    @property
    def fingerprint(self) -> str:
        return fingerprint(asdict(self))

    @property
    def gate(self) -> dict | None:
        """Arguments of the gate, None where it is off."""
        return {"min_score": self.gate_min_score, "min_top": self.gate_min_top_score} if self.gate_enabled else None

    def grid(self, chunkers: list[str], retrievers: list[str], rerankers: list[str | None]) -> list[Settings]:
        """This configuration with each combination, in nested order."""
        return [replace(self, chunker=c, retriever=r, reranker=x) for c, r, x in product(chunkers, retrievers, rerankers)]


def load(path: str | None = None, overrides: dict | None = None) -> tuple[Settings, dict]:
    """Settings from the ``pipeline`` part of a YAML file with ``overrides`` merged in, and the file's other parts. A name that isn't one of the settings is an error."""
    raw: dict = {}
    if path:
        import yaml  # needed for files alone

        with open(path) as f:
            raw = yaml.safe_load(f) or {}
        if not isinstance(raw, dict):
            raise ValueError(f"{path}: names and values expected")
    raw = merge(raw, overrides or {})
    own = raw.pop("pipeline", None) or {}
    if unknown := sorted(set(own) - {f.name for f in fields(Settings)}):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return Settings(**own), raw
