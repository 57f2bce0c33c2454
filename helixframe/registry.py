"""Named modules of DataFrame steps, and pipelines of steps with dependencies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from helixframe.operators import matrix

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Module:
    """An omics module: how its matrices are filtered, normalised and judged."""

    name: str
    category: str
    preprocess: Step = lambda df: df
    normalize: Step = lambda df: df
    quality: Step = matrix.library_sizes
    active: bool = True


class Registry:
    """Modules by lower-case name; a name is taken once."""

    def __init__(self) -> None:
        self._modules: dict[str, Module] = {}

    def register(self, module: Module) -> None:
        key = module.name.lower()
        if key in self._modules:
            raise ValueError(f"{module.name!r} is registered already")
        self._modules[key] = module

    def get(self, name: str) -> Module:
        return self._modules[name.lower()]

    def list_modules(self, category: str | None = None, active_only: bool = True) -> list[Module]:
        return [m for m in self._modules.values() if (category is None or m.category == category) and (m.active or not active_only)]


def default_registry() -> Registry:
    registry = Registry()
    for module in (
        Module("transcriptomics", "core", matrix.min_count_filter, matrix.cpm), Module("proteomics", "core", lambda df: matrix.impute(matrix.missing_filter(df, 0.5), "min"), matrix.median_scale),
        Module("metabolomics", "core", lambda df: matrix.impute(matrix.missing_filter(df, 0.3), "half_min"), matrix.pqn), Module("lipidomics", "core", lambda df: matrix.impute(matrix.missing_filter(df, 0.3), "half_min"), matrix.cpm),
        Module("epigenomics", "core", matrix.variance_filter, matrix.rank_normal), Module("metagenomics", "core", matrix.prevalence_filter, matrix.relative),
        Module("singlecell", "specialized", matrix.cell_gene_filter, lambda df: matrix.library_scale(df, True)), Module("spatialomics", "specialized", matrix.spot_filter, lambda df: matrix.library_scale(df, True)),
        Module("cytomics", "specialized", lambda df: df, matrix.arcsinh), Module("radiomics", "specialized", matrix.variance_percentile_filter, matrix.zscore), Module("exposomics", "specialized", lambda df: matrix.impute(df, "median"), matrix.zscore),
        Module("glycomics", "modifications", lambda df: df, matrix.relative), Module("phosphoproteomics", "modifications", lambda df: df, matrix.median_center),
    ):
        registry.register(module)
    return registry


@dataclass
class PipelineStep:
    name: str
    run: Step
    after: tuple[str, ...] = ()
    required: bool = True


@dataclass
class Pipeline:
    """Steps in order; each takes the frame that the last step left. A step whose dependencies did not run is an error if it is required."""

    steps: list[PipelineStep]
    log: list[tuple[str, str]] = field(default_factory=list)

    def run(self, df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
        done: set[str] = set()
        for step in self.steps:
            if step.name in skip:
                self.log.append((step.name, "skipped"))
                continue
            if missing := [d for d in step.after if d not in done]:
                if step.required:
                    raise ValueError(f"{step.name} needs {', '.join(missing)}")
                self.log.append((step.name, "left out"))
                continue
            try:
                df = step.run(df)
            except Exception as error:
                if step.required:
                    raise
                self.log.append((step.name, f"failed: {error}"))
                continue
            done.add(step.name)
            self.log.append((step.name, "done"))
        return df
