"""Validated, immutable settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from thicket.models import EmbeddingModel, HashedEmbedding, LeadSummary, OverlapAnswer, QAModel, SummarizationModel

SELECTION = ("top_k", "threshold")


def within(name: str, value: object, least: int, most: int | None = None) -> int:
    """value, if it is a whole number of the range."""
    if not isinstance(value, int) or isinstance(value, bool) or value < least or (most is not None and value > most):
        raise ValueError(f"{name} is {value!r}, but must be a whole number of at least {least}" + (f" and at most {most}" if most is not None else ""))
    return value


def kind_of(name: str, value: object, *kinds: type):  # noqa: ANN201
    """value, if it is of one of the kinds."""
    if not isinstance(value, kinds):
        raise ValueError(f"{name} is {value!r}, but must be of type {' or '.join(k.__name__ for k in kinds)}")
    return value


def one_of(name: str, value: object, known: object):  # noqa: ANN201
    """value, if it is known."""
    if value not in known:
        raise ValueError(f"{name} is {value!r}, but must be one of {', '.join(map(str, known))}")
    return value


def _share(name: str, value: object, *kinds: type) -> None:
    if not 0 <= kind_of(name, value, *kinds) <= 1:
        raise ValueError(f"{name} is {value!r}, but must lie between 0 and 1")


_NONE = type(None)


@dataclass(frozen=True)
class TreeConfig:
    """How trees are built.  threshold and top_k are for neighbour selection among nodes: a tree of clusters has no part for them, one of neighbours takes top_k; the clustering's own threshold is cluster_threshold.  encode: a tokenizer of Python's; None counts words."""

    max_tokens: int = 100
    num_layers: int = 5
    threshold: float = 0.5
    top_k: int = 5
    selection_mode: str = "top_k"
    summarization_length: int = 100
    summarization_model: SummarizationModel = field(default_factory=LeadSummary)
    embedding_models: dict[str, EmbeddingModel] = field(default_factory=lambda: {"EMB": HashedEmbedding()})
    cluster_embedding_model: str = "EMB"
    encode: Callable[[str], object] | None = None

    def __post_init__(self) -> None:
        for name in ("max_tokens", "num_layers", "top_k"):
            within(name, getattr(self, name), 1)
        _share("threshold", self.threshold, int, float)
        one_of("selection_mode", self.selection_mode, SELECTION)
        kind_of("summarization_model", self.summarization_model, SummarizationModel)
        for name, model in kind_of("embedding_models", self.embedding_models, dict).items():
            kind_of(f"embedding_models[{name!r}]", model, EmbeddingModel)
        one_of("cluster_embedding_model", self.cluster_embedding_model, self.embedding_models)


@dataclass(frozen=True)
class ClusterConfig(TreeConfig):
    """Trees whose layers are clusters, made by clustering_algorithm (None: the mixtures of operators.cluster) with
    clustering_params for its settings.  part_rows: a group of more rows is fitted and assigned in parts of about so
    many; the result is the same."""

    reduction_dimension: int = 10
    max_length_in_cluster: int = 3500
    cluster_threshold: float = 0.1
    max_clusters: int = 50
    seed: int = 224
    part_rows: int = 4000
    max_splits: int = 30
    clustering_algorithm: object | None = None
    clustering_params: dict[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        super().__post_init__()
        for name in ("reduction_dimension", "max_length_in_cluster", "max_clusters", "part_rows", "max_splits"):
            within(name, getattr(self, name), 1)
        _share("cluster_threshold", self.cluster_threshold, int, float)
        kind_of("clustering_params", self.clustering_params, dict)
        if self.clustering_algorithm is not None and not callable(getattr(self.clustering_algorithm, "perform_clustering", None)):
            raise ValueError(f"clustering_algorithm is {self.clustering_algorithm!r}, but must have a perform_clustering method")


@dataclass(frozen=True)
class RetrieverConfig:
    threshold: float = 0.5
    top_k: int = 5
    selection_mode: str = "top_k"
    context_embedding_model: str = "EMB"
    embedding_model: EmbeddingModel = field(default_factory=HashedEmbedding)
    num_layers: int | None = None
    start_layer: int | None = None

    def __post_init__(self) -> None:
        _share("threshold", self.threshold, float)
        within("top_k", self.top_k, 1)
        one_of("selection_mode", self.selection_mode, SELECTION)
        kind_of("context_embedding_model", self.context_embedding_model, str)
        kind_of("embedding_model", self.embedding_model, EmbeddingModel)
        for name in ("num_layers", "start_layer"):
            if getattr(self, name) is not None:
                within(name, getattr(self, name), 0)


@dataclass(frozen=True)
class FlatConfig:
    """max_context_tokens None: no budget."""

    max_tokens: int = 100
    max_context_tokens: int | None = 3500
    use_top_k: bool = False
    top_k: int = 5
    embedding_model: EmbeddingModel | None = None
    question_embedding_model: EmbeddingModel | None = None
    embedding_model_string: str = "EMB"
    encode: Callable[[str], object] | None = None

    def __post_init__(self) -> None:
        within("max_tokens", self.max_tokens, 1)
        within("top_k", self.top_k, 1)
        if self.max_context_tokens is not None:
            within("max_context_tokens", self.max_context_tokens, 1)
        for name in ("embedding_model", "question_embedding_model"):
            kind_of(name, getattr(self, name), EmbeddingModel, _NONE)

    @property
    def embedder(self) -> EmbeddingModel:
        return self.embedding_model or HashedEmbedding()

    @property
    def question_embedder(self) -> EmbeddingModel:
        return self.question_embedding_model or self.embedder


@dataclass(frozen=True)
class EngineConfig:
    """Of the whole engine.  retriever: settings of the tree's retriever, or of flat retrieval over its leaves.
    embedding_model and summarization_model are shortcuts that set both sides, and exclude the settings they stand for."""

    tree: ClusterConfig | None = None
    retriever: RetrieverConfig | FlatConfig | None = None
    qa_model: QAModel | None = None
    embedding_model: EmbeddingModel | None = None
    summarization_model: SummarizationModel | None = None
    tree_builder_type: str = "cluster"

    def __post_init__(self) -> None:
        from thicket.plans.build import BUILDERS

        one_of("tree_builder_type", self.tree_builder_type, BUILDERS)
        kinds = {"qa_model": (QAModel,), "embedding_model": (EmbeddingModel,), "summarization_model": (SummarizationModel,), "tree": (ClusterConfig,), "retriever": (RetrieverConfig, FlatConfig)}
        for name, kind in kinds.items():
            kind_of(name, getattr(self, name), *kind, _NONE)
        own = self.tree or ClusterConfig()
        for shortcut, other, plain in (("embedding_model", "embedding_models", set(own.embedding_models) == {"EMB"}), ("summarization_model", "summarization_model", isinstance(own.summarization_model, LeadSummary))):
            if getattr(self, shortcut) is not None and not plain:
                raise ValueError(f"{shortcut} and tree.{other} both say which model to use; give one of them")

    def resolved(self) -> tuple[ClusterConfig, RetrieverConfig | FlatConfig, QAModel]:
        tree, retriever = self.tree or ClusterConfig(), self.retriever or RetrieverConfig()
        if self.embedding_model is not None:
            tree = replace(tree, embedding_models={"EMB": self.embedding_model}, cluster_embedding_model="EMB")
            name = "embedding_model_string" if isinstance(retriever, FlatConfig) else "context_embedding_model"
            retriever = replace(retriever, embedding_model=self.embedding_model, **{name: "EMB"})
        if self.summarization_model is not None:
            tree = replace(tree, summarization_model=self.summarization_model)
        return tree, retriever, self.qa_model or OverlapAnswer()
