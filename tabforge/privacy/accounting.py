"""Zero-concentrated differential privacy: from (epsilon, delta) to rho and noise, and a ledger of what was spent."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Callable, Iterable, Mapping
from decimal import Decimal

from tabforge.schema import EngineError


def _crossing(below: Callable[[float], bool], low: float, high: float, halvings: int = 200) -> float:
    """Where a condition that holds on the left stops to hold, from the left."""
    for _ in range(halvings):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) else (low, middle)
    return low


def delta_of(rho: float, epsilon: float) -> float:
    """The least delta that rho-zCDP gives for epsilon.

    By Canonne, Kamath and Steinke (2020), Proposition 12: the bound exp((a - 1)(a rho - epsilon)) (1 - 1 / a)^a / (a - 1) holds for every
    order a > 1; it is least where its logarithm's slope changes sign.
    """
    if rho <= 0:
        return 0.0
    shrink = lambda a: math.log1p(-1 / a)
    a = _crossing(lambda a: rho * (2 * a - 1) + shrink(a) < epsilon, 1.01, 2 + (1 + epsilon) / (2 * rho))
    return min(1.0, math.exp((a - 1) * (rho * a - epsilon) + a * shrink(a)) / (a - 1))


def rho_of(epsilon: float, delta: float) -> float:
    """The greatest rho whose delta for epsilon is at most delta."""
    if not (epsilon > 0 and 0 < delta < 1):
        raise ValueError("epsilon must be positive and delta between 0 and 1")
    return _crossing(lambda rho: delta_of(rho, epsilon) <= delta, 0.0, epsilon + 1)


def sigma_of(rho: float) -> float:
    """The noise of a measurement phase that a third of rho pays for."""
    return math.sqrt(3 / (2 * rho))


class Ledger:
    """An append-only JSON-lines ledger of runs: reserved, spent just before the first private read, then released.

    Aborting before the first read is free; after it, what was spent stays spent.
    """

    #: Fixed values.
    NEXT = {None: ("reserved",), "reserved": ("spent", "aborted"), "spent": ("released", "aborted"), "released": (), "aborted": ()}

    def __init__(self, path: str):
        self.path = path

    def _events(self) -> list[dict]:
        if not os.path.exists(self.path):
            return []
        with open(self.path, encoding="utf-8") as f:
            return [json.loads(line) for line in f if line.strip()]

    def runs(self) -> dict[str, dict]:
        out: dict[str, dict] = {}
        for e in self._events():
            run = out.setdefault(e["run"], {"state": None, "was_spent": False})
            run |= {k: v for k, v in e.items() if k != "run"}
            run["was_spent"] |= e["state"] == "spent"
        return out

    def record(self, run: str, state: str, epsilon: str | None = None, delta: str | None = None) -> None:
        now = self.runs().get(run, {"state": None})["state"]
        if state not in self.NEXT[now]:
            raise EngineError("INVALID_STATE", f"{run}: {now} to {state}")
        if state == "reserved" and not (epsilon and delta and Decimal(epsilon) > 0 and 0 < Decimal(delta) < 1):
            raise EngineError("INVALID_STATE", f"{run}: a reservation states epsilon and delta")
        line = {"run": run, "state": state} | ({"epsilon": str(epsilon), "delta": str(delta)} if state == "reserved" else {})
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(line, sort_keys=True) + "\n")
            f.flush()
            os.fsync(f.fileno())

    def spent(self) -> tuple[Decimal, Decimal]:
        return composed(self.runs().values())


def composed(runs: Iterable[Mapping]) -> tuple[Decimal, Decimal]:
    """Summed epsilon and delta of the runs that were spent, released or not."""
    own = [r for r in runs if r.get("was_spent") or r["state"] in ("spent", "released")]
    return sum((Decimal(r["epsilon"]) for r in own), Decimal(0)), sum((Decimal(r["delta"]) for r in own), Decimal(0))
