"""Rate models and Boolean networks: one simulation a row of a parameter table, side by side."""

from __future__ import annotations

import ast
import math
import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow}
_CALLS = {"exp": math.exp, "log": math.log, "sqrt": math.sqrt, "min": min, "max": max, "abs": abs}


def compiled(law: str) -> Callable[[dict[str, float]], float]:
    """A rate law of numbers, names, + - * / ** and a few functions; nothing else is evaluated."""

    def build(node: ast.AST) -> Callable[[dict[str, float]], float]:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return lambda env, v=float(node.value): v
        if isinstance(node, ast.Name):
            return lambda env, n=node.id: env[n]
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            f, a, b = _BINARY[type(node.op)], build(node.left), build(node.right)
            return lambda env: f(a(env), b(env))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            a = build(node.operand)
            return lambda env: -a(env)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and not node.keywords:
            f, parts = _CALLS[node.func.id], [build(x) for x in node.args]
            return lambda env: f(*(p(env) for p in parts))
        raise ValueError(f"not allowed in a rate law: {law!r}")

    return build(ast.parse(law, mode="eval").body)


@dataclass
class RateModel:
    """Species with starting amounts, parameters, and reactions (law, {species: change})."""

    species: dict[str, float]
    parameters: dict[str, float]
    reactions: list[tuple[str, dict[str, float]]] = field(default_factory=list)

    def slope(self, parameters: dict[str, float]) -> Callable[[np.ndarray], np.ndarray]:
        names, laws = list(self.species), [(compiled(law), change) for law, change in self.reactions]

        def f(y: np.ndarray) -> np.ndarray:
            env = parameters | dict(zip(names, y.tolist()))
            dy = np.zeros(len(names))
            for law, change in laws:
                v = law(env)
                for s, c in change.items():
                    dy[names.index(s)] += c * v
            return dy

        return f

    def simulate(self, times: list[float], parameters: dict[str, float] | None = None) -> np.ndarray:
        """Amounts at the times (fourth-order Runge-Kutta between them, never below zero)."""
        f, y = self.slope(self.parameters | (parameters or {})), np.array(list(self.species.values()), dtype=float)
        out = [y]
        for a, b in zip(times, times[1:]):
            h = b - a
            k1 = f(y)
            k2 = f(y + h / 2 * k1)
            k3 = f(y + h / 2 * k2)
            y = np.maximum(y + h / 6 * (k1 + 2 * k2 + 2 * k3 + f(y + h * k3)), 0)
            out.append(y)
        return np.array(out)

    def steady_state(self, parameters: dict[str, float] | None = None, step: float = 0.01, rounds: int = 10_000, tolerance: float = 1e-8) -> np.ndarray:
        f, y = self.slope(self.parameters | (parameters or {})), np.array(list(self.species.values()), dtype=float)
        for _ in range(rounds):
            dy = f(y)
            if np.abs(dy).max() < tolerance:
                break
            y = np.maximum(y + step * dy, 0)
        return y

    def eigenvalues(self, state: np.ndarray, parameters: dict[str, float] | None = None, delta: float = 1e-6) -> np.ndarray:
        """Of the numeric Jacobian: all real parts negative means stable."""
        f = self.slope(self.parameters | (parameters or {}))
        return np.linalg.eigvals(np.array([(f(state + delta * e) - f(state - delta * e)) / (2 * delta) for e in np.eye(len(state))]).T)


def simulate_grid(model: RateModel, grid: DataFrame, times: list[float], key: str = "run") -> DataFrame:
    """(key, time, species, amount) of a simulation for each row of parameters in `grid`."""
    names = [c for c in grid.columns if c != key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                found = model.simulate(times, {n: float(r[n]) for n in names})
                n = len(model.species)
                yield pd.DataFrame({key: r[key], "time": np.repeat(times, n), "species": list(model.species) * len(times), "amount": found.ravel()})

    return grid.mapInPandas(run, f"{key} {dict(grid.dtypes)[key]}, time double, species string, amount double")


def local_sensitivity(model: RateModel, spark: SparkSession, times: list[float], species: str, delta: float = 0.01) -> DataFrame:
    """(parameter, sensitivity): relative change of the last amount by a relative change of each parameter."""
    rows = [("", *model.parameters.values())] + [(p, *(v * (1 + delta) if q == p else v for q, v in model.parameters.items())) for p in model.parameters]
    grid = spark.createDataFrame(rows, "run string, " + ", ".join(f"{p} double" for p in model.parameters))
    last = simulate_grid(model, grid, times).where((F.col("species") == species) & (F.col("time") == times[-1]))
    base = F.broadcast(last.where("run = ''").select(F.col("amount").alias("base")))
    return last.where("run <> ''").crossJoin(base).select(F.col("run").alias("parameter"), F.when(F.col("base") != 0, (F.col("amount") - F.col("base")) / F.col("base") / delta).alias("sensitivity"))


def sweep(model: RateModel, spark: SparkSession, parameter: str, values: list[float]) -> DataFrame:
    """(value, species, amount) of the steady state for each value of a parameter."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for v in batch["value"]:
                yield pd.DataFrame({"value": v, "species": list(model.species), "amount": model.steady_state({parameter: float(v)})})

    return spark.createDataFrame([(float(v),) for v in values], "value double").mapInPandas(run, "value double, species string, amount double")


# --- Boolean networks -------------------------------------------------------------------------------------------------


def boolean_step(rules: DataFrame, states: DataFrame) -> DataFrame:
    """(run, node, value) one synchronous step on: a node with rules (target, source, sign) of `logic` AND or OR follows its sources, others stay."""
    signal = F.when(F.col("sign") > 0, F.col("value")).otherwise(~F.col("value"))
    moved = rules.join(states.withColumnRenamed("node", "source"), "source").groupBy("run", F.col("target").alias("node")).agg(F.when(F.first("logic") == "AND", F.min(signal)).otherwise(F.max(signal)).alias("next"))
    return states.join(moved, ["run", "node"], "left").select("run", "node", F.coalesce("next", "value").alias("value"))


def attractors(rules: dict[str, tuple[str, list[tuple[str, int]]]], spark: SparkSession, most: int = 14) -> DataFrame:
    """(attractor, period, basin) over all states of {node: (logic, [(source, sign)])}: every state is followed until it repeats; the attractor is its smallest state."""
    names = sorted(rules)
    if len(names) > most:
        raise ValueError(f"more than {most} nodes")
    place = {n: k for k, n in enumerate(names)}

    def step(state: int) -> int:
        new = 0
        for n, (logic, sources) in rules.items():
            signals = [bool(state >> place[s] & 1) == (sign > 0) for s, sign in sources]
            value = (all(signals) if logic == "AND" else any(signals)) if signals else bool(state >> place[n] & 1)
            new |= value << place[n]
        return new

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for start in batch["id"]:
                seen, state = {}, int(start)
                while state not in seen:
                    seen[state] = len(seen)
                    state = step(state)
                cycle = [s for s, k in seen.items() if k >= seen[state]]
                out.append((min(cycle), len(cycle)))
            yield pd.DataFrame(out, columns=["attractor", "period"])

    return spark.range(1 << len(names)).mapInPandas(run, "attractor long, period int").groupBy("attractor", "period").agg(F.count("*").alias("basin"))
