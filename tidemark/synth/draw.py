"""Random draws as pure functions of a seed, a name and ids: the same on every retry, and untouched by other draws."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import ConfigError
from tidemark.functions.keyed import hashed_uniform


class Draws:
    def __init__(self, seed: int) -> None:
        self.seed = seed

    def uniform(self, name: str, *ids: Column) -> Column:
        return hashed_uniform(f"{self.seed}/{name}", *ids)

    def normal(self, name: str, *ids: Column) -> Column:
        """By Box and Muller."""
        return F.sqrt(-2.0 * F.log(self.uniform(f"{name}/r", *ids))) * F.cos(2.0 * math.pi * self.uniform(f"{name}/a", *ids))

    def integer(self, low, high, name: str, *ids: Column) -> Column:
        """Uniform in low … high, both included."""
        lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
        return (lo + F.floor(self.uniform(name, *ids) * (hi - lo + 1))).cast("bigint")

    def gamma(self, shape: float, name: str, *ids: Column) -> Column:
        """By the rejection of Marsaglia and Tsang: the first of up to 64 tries that is accepted. A try fails with less than
        5 %, so that all fail once in 10^83."""
        more = max(shape, 1.0 + shape if shape < 1 else shape)
        d = more - 1.0 / 3.0
        c = 1.0 / math.sqrt(9.0 * d)

        def tried(i: Column) -> Column:
            x = self.normal(f"{name}/x", *ids, i)
            v = F.pow(1.0 + c * x, F.lit(3))
            accepted = (v > 0) & (F.log(self.uniform(f"{name}/u", *ids, i)) < 0.5 * x * x + d - d * v + d * F.log(F.when(v > 0, v).otherwise(1.0)))
            return F.when(accepted, d * v)

        tries = F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), tried), lambda v: v.isNotNull())
        found = F.element_at(tries, 1)
        return found * F.pow(self.uniform(f"{name}/boost", *ids), F.lit(1.0 / shape)) if shape < 1 else found

    @staticmethod
    def _thresholds(mean: float) -> Column:
        """Cumulative probabilities of 0, 1, … up to the largest number that a uniform of 53 bits can reach."""
        term = total = math.exp(-mean)
        out, k = [total], 0
        while total < 1.0 - 2.0**-53 and (term > 2.0**-60 or k < mean):
            k += 1
            term *= mean / k
            total += term
            out.append(min(1.0, total))
        return F.array(*map(F.lit, out))

    def poisson(self, mean: float, name: str, *ids: Column) -> Column:
        """By inversion, exact for means up to some 700, where exp(-mean) is still a number."""
        if not 0 <= mean <= 700:
            raise ConfigError(f"a mean of {mean} is out of range")
        u = self.uniform(name, *ids)
        return F.size(F.filter(self._thresholds(float(mean)), lambda c: c < u))

    def poisson_by(self, key: Column, means: Mapping[str, float], name: str, *ids: Column) -> Column:
        """The same with a mean for each value of a key; 0 for other keys."""
        table = F.array(F.lit(1.0))
        for value, mean in means.items():
            if not 0 <= mean <= 700:
                raise ConfigError(f"a mean of {mean} is out of range")
            table = F.when(key == value, self._thresholds(float(mean))).otherwise(table)
        u = self.uniform(name, *ids)
        return F.size(F.filter(table, lambda c: c < u))

    def sample(self, d: Mapping, name: str, *ids: Column) -> Column:
        """A draw from a configured distribution."""
        kind = d["kind"]
        if kind == "LogNormal":
            return F.lit(float(d["median"])) * F.exp(self.normal(name, *ids) * float(d["sigma"]))
        if kind == "Gamma":
            return self.gamma(float(d["shape"]), name, *ids) * float(d["scale"])
        if kind == "Uniform":
            return F.lit(float(d["low"])) + self.uniform(name, *ids) * float(d["high"] - d["low"])
        if kind == "ShiftedPoisson":
            return (self.poisson(float(d["mean"]), name, *ids) + int(d["shift"])).cast("double")
        if kind == "Beta":
            a, b = self.gamma(float(d["a"]), f"{name}/x", *ids), self.gamma(float(d["b"]), f"{name}/y", *ids)
            return a / F.greatest(a + b, F.lit(1e-12))
        if kind == "Constant":
            return F.lit(float(d["value"]))
        return self.choice(list(map(float, d["values"])), d["weights"], name, *ids)

    def choice(self, values, weights, name: str, *ids: Column) -> Column:
        u, total, acc = self.uniform(name, *ids), float(sum(weights)), 0.0
        out = F.lit(values[-1])
        steps = []
        for v, w in zip(values, weights, strict=True):
            acc += w / total
            steps.append((acc, v))
        for upto, v in reversed(steps[:-1]):
            out = F.when(u < upto, F.lit(v)).otherwise(out)
        return out
