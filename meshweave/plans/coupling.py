"""Codes, couplings and control parameters: what is declared before any data move."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METHODS = ("identity", "nearest_sources", "nearest_targets", "location", "location_octree", "location_boxtree", "location_all", "intersection")
INTERFACES = ("point", "linear", "surface", "volume")
DOFS = ("cell", "node", "user")
KINDS = {"int": int, "double": float, "string": str}
#: What each option is called, its type and its default.
OPTIONS = {"n_neighbors": (int, 4), "polyfit_degree": (int, 1), "tolerance": (float, 1e-3)}


class CouplingError(ValueError):
    """A declaration that contradicts itself or its counterpart."""


@dataclass(frozen=True)
class CouplingSpec:
    """One coupling of exactly two codes: interface dimension, spatial method, mesh dynamics and options."""

    name: str
    local: str
    coupled: str
    interface: str = "surface"
    method: str = "location"
    n_part: int = 1
    displacement: str = "static"
    options: tuple[tuple[str, Any], ...] = ()

    def __post_init__(self) -> None:
        if self.local == self.coupled:
            raise CouplingError("a coupling joins two different codes")
        if self.interface not in INTERFACES or self.method not in METHODS:
            raise CouplingError(f"unknown interface or method: {self.interface}, {self.method}")
        if self.displacement not in ("static", "deformable", "variable"):
            raise CouplingError(f"unknown displacement: {self.displacement}")
        if self.interface == "point" and self.method not in ("identity", "nearest_sources", "nearest_targets"):
            raise CouplingError("points couple by nearest neighbours or identity only")
        if self.interface == "linear" and self.method == "intersection":
            raise CouplingError("linear interfaces do not couple by intersection")
        for key, value in self.options:
            self.checked(key, value)

    @staticmethod
    def checked(key: str, value: Any) -> Any:
        if key not in OPTIONS:
            raise CouplingError(f"unknown option: {key}")
        if type(value) is not OPTIONS[key][0]:
            raise CouplingError(f"{key} takes {OPTIONS[key][0].__name__}")
        return value

    def option(self, key: str) -> Any:
        return dict(self.options).get(key, OPTIONS[key][1])

    def with_option(self, key: str, value: Any) -> CouplingSpec:
        made = tuple((k, v) for k, v in self.options if k != key) + ((key, self.checked(key, value)),)
        return CouplingSpec(self.name, self.local, self.coupled, self.interface, self.method, self.n_part, self.displacement, made)

    def matches(self, other: CouplingSpec) -> None:
        """Both sides must agree on the dimension and the method."""
        if (self.interface, self.method) != (other.interface, other.method) or {self.local, self.coupled} != {other.local, other.coupled}:
            raise CouplingError("the two sides declare different couplings")

    def check_field(self, source_dof: str, target_dof: str) -> None:
        if source_dof not in DOFS or target_dof not in DOFS:
            raise CouplingError("unknown dof location")
        if self.method == "intersection" and (source_dof, target_dof) != ("cell", "cell"):
            raise CouplingError("intersection needs cell-centred fields on both sides")
        if self.method.startswith("location") and source_dof == "user":
            raise CouplingError("location needs a source on a mesh")


@dataclass
class Params:
    """Control parameters of all codes: (code, name, kind) to value, with a version for optimistic updates."""

    values: dict[tuple[str, str, str], Any] = field(default_factory=dict)
    version: int = 0
    locked: dict[str, str] = field(default_factory=dict)

    def _may_write(self, code: str, by: str | None) -> None:
        """Parameters of a locked code change by its holder alone."""
        if code in self.locked and self.locked[code] != by:
            raise CouplingError(f"{code} is locked by {self.locked[code]}")

    def _put(self, code: str, name: str, value: Any, new: bool, by: str | None) -> None:
        self._may_write(code, by)
        kind = next((k for k, t in KINDS.items() if type(value) is t), None)
        if kind is None:
            raise CouplingError("parameters are int, double or string")
        if ((code, name, kind) in self.values) == new:
            raise CouplingError(f"{name} {'exists already' if new else 'does not exist'}")
        self.values[code, name, kind] = value
        self.version += 1

    def add(self, code: str, name: str, value: Any, by: str | None = None) -> None:
        """`by`: the code that writes, where it holds a lock."""
        self._put(code, name, value, True, by)

    def set(self, code: str, name: str, value: Any, by: str | None = None) -> None:
        self._put(code, name, value, False, by)

    def delete(self, code: str, name: str, kind: str, by: str | None = None) -> None:
        self._may_write(code, by)
        self.get(code, name, kind)
        del self.values[code, name, kind]
        self.version += 1

    def has(self, code: str, name: str, kind: str) -> bool:
        return (code, name, kind) in self.values

    def get(self, code: str, name: str, kind: str) -> Any:
        if not self.has(code, name, kind):
            raise CouplingError(f"{code} has no {kind} parameter {name}")
        return self.values[code, name, kind]

    def names(self, code: str, kind: str) -> list[str]:
        return sorted(n for c, n, k in self.values if (c, k) == (code, kind))

    def count(self, code: str, kind: str) -> int:
        return len(self.names(code, kind))

    def reduce(self, op: str, name: str, kind: str, codes: Iterable[str]) -> Any:
        if kind == "string":
            raise CouplingError("strings have no minimum, maximum or sum here")
        found = [self.get(c, name, kind) for c in codes]
        return {"min": min, "max": max, "sum": sum}[op](found)

    @contextmanager
    def lock(self, code: str, by: str | None = None):
        """Within, only `by` (the code itself if not given) adds, sets or deletes parameters of `code`."""
        if code in self.locked:
            raise CouplingError(f"{code} is locked by {self.locked[code]}")
        self.locked[code] = by or code
        try:
            yield self
        finally:
            del self.locked[code]

    def synchronize(self, other: Params) -> None:
        """Take over the other's parameters; common ones must be equal."""
        differing = [k for k in self.values.keys() & other.values.keys() if self.values[k] != other.values[k]]
        if differing:
            raise CouplingError(f"parameters differ: {sorted(differing)}")
        for code in {c for c, _, _ in other.values.keys() - self.values.keys()}:
            self._may_write(code, None)
        self.values |= other.values
        self.version += 1

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(c, n, k, *(v if k == x else None for x in KINDS)) for (c, n, k), v in sorted(self.values.items())]
        return spark.createDataFrame(rows, "code string, name string, type string, i int, d double, s string")

    def dump(self) -> str:
        return json.dumps([{"code": c, "name": n, "type": k, "value": v} for (c, n, k), v in sorted(self.values.items())])


def reduced(params: DataFrame, value: str = "d") -> DataFrame:
    """(name, min_value, max_value, sum_value) of a parameter table over its codes."""
    return params.groupBy("name").agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.sum(value).alias("sum_value"))


class Timer:
    """Elapsed and CPU time over any number of runs."""

    def __init__(self) -> None:
        self.elapsed = self.cpu = 0.0
        self._began: tuple[float, float] | None = None

    def resume(self) -> None:
        self._began = time.perf_counter(), time.process_time()

    def hang_on(self) -> None:
        if self._began:
            self.elapsed += time.perf_counter() - self._began[0]
            self.cpu += time.process_time() - self._began[1]
            self._began = None


@dataclass
class Field:
    """A declared field; `data` has gnum and value (array of double)."""

    name: str
    n_components: int = 1
    source_dof: str = "node"
    target_dof: str = "node"
    storage: str = "interlaced"
    data: DataFrame | None = None
    interpolate: Callable | None = None
    #: The step it was exchanged in last, None before the first exchange in a step.
    exchanged_at: int | None = None
    #: Whether it is written at the end of a step that did not exchange it, marked as such.
    visible: bool = True


class Coupling:
    """The live side of a CouplingSpec: meshes, points, fields, the mapping and its slots."""

    def __init__(self, spec: CouplingSpec, session: Session):
        self.spec, self.session = spec, session
        self.fields: dict[str, Field] = {}
        self.mapping: DataFrame | None = None
        self.slots: dict[Any, DataFrame | None] = {}
        self.slot: Any = None
        self.source: dict[str, DataFrame] = {}
        self.target: DataFrame | None = None
        self.user_data: Any = None
        self.output: tuple[Any, DataFrame, DataFrame | None] | None = None
        self.step, self.written_at = -1, None
        self._made: list[DataFrame] = []

    @property
    def codes(self) -> tuple[str, str]:
        return self.spec.local, self.spec.coupled

    @property
    def in_step(self) -> bool:
        """Whether one of its two codes has a step open."""
        return any(self.session.clocks[c].open for c in self.codes)

    def began(self, step: int, again: bool) -> None:
        """One of its codes opened `step`. The coupling is in the largest step that one of them began: the first to open
        it lets the mapping of a changing mesh go, the other finds it as it is. `again`: a step that failed is redone."""
        if step > self.step or again:
            self.step = step
            if again:
                for x in self.fields.values():
                    x.exchanged_at = None if x.exchanged_at == step else x.exchanged_at
            if self.spec.displacement != "static":
                self.mapping = None

    def ended(self) -> None:
        """A code ended its step. Once none is open, fields that the step did not exchange are written, marked as such."""
        if self.output is None or self.in_step or not self.output[0].due(max(self.step, 0)):
            return
        for name, x in self.fields.items():
            if x.visible and x.exchanged_at != self.step and self.target is not None:
                writer, elements = self.open_output()
                where = "node" if x.target_dof == "node" else "element"
                nothing = self.target.select("gnum", F.array_repeat(F.lit(None).cast("double"), x.n_components).alias("value"))
                writer.write_field(name, nothing, where, elements)
                writer.write_status(name, self.target.select("gnum"), None, where, elements)

    def changed(self) -> None:
        """A new mesh or new targets: refused once a static coupling has its mapping, else the mapping goes."""
        if self.mapping is not None and self.spec.displacement == "static":
            raise CouplingError("the meshes of a static coupling do not change")
        self.mapping = None

    def enable_output(self, writer: Any, vertices: DataFrame, elements: DataFrame | None = None) -> None:
        """Let exchanges write their results through `writer` (sources.writers), in the steps that it says are due. A
        coupling whose meshes change may be given others in each step, before its exchanges."""
        self.output = writer, vertices, elements

    def open_output(self) -> tuple[Any, DataFrame | None]:
        """The writer, in the coupling's step: the geometry is written before the first field, and of a changing mesh
        again before the first field of each step."""
        writer, vertices, elements = self.output
        step, moving = max(self.step, 0), self.spec.displacement != "static"
        if self.written_at != step:
            first = writer.begin_step(max(self.session.clocks[c].now for c in self.codes), step)
            if moving or first or self.written_at is None:
                writer.write_mesh(vertices, elements, moving)
            self.written_at = step
        return writer, elements

    def set_option(self, key: str, value: Any) -> None:
        self.spec = self.spec.with_option(key, value)
        self.mapping = None

    def set_source(self, **frames: DataFrame) -> None:
        """cells=..., nodes=... or points=...; deformable and variable couplings take new ones at any step."""
        self.changed()
        self.source |= frames

    def set_targets(self, points: DataFrame) -> None:
        self.changed()
        self.target = points

    def field(self, name: str, **declared: Any) -> Field:
        if name in self.fields:
            raise CouplingError(f"field {name} exists already")
        made = Field(name, **declared)
        self.spec.check_field(made.source_dof, made.target_dof)
        self.fields[name] = made
        return made

    def delete_field(self, name: str) -> None:
        del self.fields[name]

    def compute_mapping(self) -> DataFrame:
        """Build the mapping once; later exchanges reuse it until mesh, targets or options change."""
        from meshweave.operators import intersection, location, nearest
        from meshweave.plans.durable import removed, stored

        if self.mapping is None:
            method, option = self.spec.method, self.spec.option
            if method == "identity":
                from meshweave.operators.exchange import identity_mapping

                made = identity_mapping(self.source["points"], self.target)
            elif method == "nearest_sources":
                made = nearest.nearest_sources(self.target, self.source["points"], option("n_neighbors"))
            elif method == "nearest_targets":
                made = nearest.nearest_targets(self.target, self.source["points"], option("n_neighbors"))
            elif method == "intersection":
                made = intersection.overlap(self.source["cells"], self.target)
            else:
                made = location.locate(self.target, self.source["cells"], option("tolerance"), every=method == "location_all")
            self.mapping = stored(made)
            if self.spec.displacement != "static":
                self._made.append(self.mapping)
                held = [self.mapping, *self.slots.values()]
                while self.session.retain is not None and len(self._made) > self.session.retain:
                    old = self._made.pop(0)
                    if not any(old is x for x in held):
                        removed(old)
        return self.mapping

    def save_mapping(self, path: str) -> None:
        self.compute_mapping().write.mode("overwrite").parquet(path)

    def load_mapping(self, spark: SparkSession, path: str) -> None:
        self.mapping = spark.read.parquet(path)

    def use_slot(self, index: Any) -> None:
        """Mappings of a cyclic mesh: the current one stays under its index, and what `index` had comes back."""
        self.slots[self.slot] = self.mapping
        self.slot, self.mapping = index, self.slots.get(index)

    def exchange(self, name: str) -> DataFrame:
        """The field at every target, once a step: (gnum, value), or (component, gnum, value) for interleaved storage, in
        which its data are also taken.

        Targets that no source reaches get NULL; zeros where the mapping is an overlap or by nearest neighbours.
        """
        from meshweave.operators import interpolate

        made = self.fields[name]
        if self.in_step and made.exchanged_at == self.step:
            raise CouplingError(f"{name} was exchanged in this step")
        if made.data is None:
            raise CouplingError(f"{name} has no data")
        mapping = self.compute_mapping()
        data = interpolate.interlaced(made.data) if made.storage == "interleaved" else made.data
        zero = False
        if made.interpolate is not None:
            value = interpolate.user_defined(mapping, data, made.interpolate)
        elif self.spec.method == "intersection":
            value, zero = interpolate.conservative(mapping, data), True
        elif self.spec.method.startswith("nearest"):
            value, zero = interpolate.least_squares(mapping, data, self.spec.option("polyfit_degree")), True
        elif self.spec.method == "identity" or made.source_dof == "cell":
            value = interpolate.copied(mapping, data)
        else:
            value = interpolate.weighted_nodes(mapping, data)
        whole = interpolate.filled(self.target, value, made.n_components, zero)
        self.write(name, made, whole, mapping)
        if self.in_step:  # only now: an exchange that failed can be made again
            made.exchanged_at = self.step
        return interpolate.interleaved(whole) if made.storage == "interleaved" else whole

    def write(self, name: str, made: Field, whole: DataFrame, mapping: DataFrame) -> None:
        """The result and who was reached, where output is enabled and this step is due."""
        if self.output is None or not self.output[0].due(max(self.step, 0)):
            return
        writer, elements = self.open_output()
        where = "node" if made.target_dof == "node" else "element"
        writer.write_field(name, whole, where, elements)
        writer.write_status(name, self.target.select("gnum"), mapping, where, elements)


@dataclass
class Clock:
    """The time steps of one code."""

    step: int = -1
    open: bool = False
    now: float = 0.0


class Session:
    """Codes with their states, steps, parameters and couplings.

    Every code counts its own steps. A coupling keeps the mappings of its last `retain` steps (None: all): results of an
    exchange on a changing mesh are to be read or written before as many further steps have mapped.
    """

    def __init__(self, spark: SparkSession, codes: Iterable[str], local: Iterable[str] | None = None, retain: int | None = 2):
        self.spark, self.codes = spark, list(dict.fromkeys(codes))
        self.local = list(self.codes if local is None else local)
        self.params, self.couplings = Params(), {}
        self.clocks, self.retain = {c: Clock() for c in self.codes}, retain
        self.user: dict[str, Any] = {}
        self.log = logging.getLogger("meshweave")
        for code in self.codes:
            self.params.add(code, "time", 0.0)
            self.params.add(code, "state", "in_progress")

    def set_state(self, code: str, state: str) -> None:
        if state not in ("in_progress", "end", "output_error"):
            raise CouplingError(f"unknown state: {state}")
        self.params.set(code, "state", state)

    def state(self, code: str) -> str:
        return self.params.get(code, "state", "string")

    @property
    def step(self) -> int:
        """The last step that a code began."""
        return max(x.step for x in self.clocks.values())

    @property
    def in_step(self) -> bool:
        return any(x.open for x in self.clocks.values())

    def clock(self, code: str) -> Clock:
        if code not in self.clocks:
            raise CouplingError(f"unknown code: {code}")
        return self.clocks[code]

    def of_code(self, code: str) -> list[Coupling]:
        return [x for x in self.couplings.values() if code in x.codes]

    def step_begin(self, code: str, now: float, step: int | None = None) -> None:
        """Open the code's next step, or `step` where its number is known from elsewhere: a number already reached is a
        step that failed and is made again. Mappings of deformable and variable couplings are computed anew in it."""
        clock = self.clock(code)
        if clock.open:
            raise CouplingError(f"{code} is in step {clock.step}")
        number = clock.step + 1 if step is None else step
        if number < clock.step:
            raise CouplingError(f"{code} is past step {number}")
        again = number == clock.step
        clock.step, clock.open, clock.now = number, True, float(now)
        self.params.set(code, "time", clock.now, by=self.params.locked.get(code))
        for cpl in self.of_code(code):
            cpl.began(number, again)

    def step_end(self, code: str) -> None:
        """Close the code's step, and no other code's."""
        clock = self.clock(code)
        if not clock.open:
            raise CouplingError(f"{code} has no step open")
        clock.open = False
        for cpl in self.of_code(code):
            cpl.ended()

    def step_failed(self, code: str) -> None:
        """Close the code's step without its end: it can be begun again under its number."""
        self.clock(code).open = False

    def saved(self) -> str:
        """Steps, parameters and output of all codes, for restored(). Meshes, data and mappings are the caller's."""
        outputs = {n: {"written_at": x.written_at, "writer": x.output[0].saved()} for n, x in self.couplings.items() if x.output is not None and hasattr(x.output[0], "saved")}
        clocks = {c: {"step": x.step, "now": x.now} for c, x in self.clocks.items()}
        return json.dumps({"clocks": clocks, "params": json.loads(self.params.dump()), "outputs": outputs, "couplings": {n: x.step for n, x in self.couplings.items()}})

    def restored(self, text: str) -> None:
        """Go on from saved(): codes and couplings of the same names take over their steps, parameters and output."""
        state = json.loads(text)
        for code, x in state["clocks"].items():
            clock = self.clock(code)
            clock.step, clock.now, clock.open = x["step"], x["now"], False
        for x in state["params"]:
            self.params.values[x["code"], x["name"], x["type"]] = KINDS[x["type"]](x["value"])
        self.params.version += 1
        for name, step in state["couplings"].items():
            if name in self.couplings:
                cpl = self.couplings[name]
                cpl.step = step
                if name in state["outputs"] and cpl.output is not None:
                    cpl.written_at = state["outputs"][name]["written_at"]
                    cpl.output[0].restored(state["outputs"][name]["writer"])

    def couple(self, spec: CouplingSpec) -> Coupling:
        if spec.name in self.couplings:
            raise CouplingError(f"coupling {spec.name} exists already")
        for code in (spec.local, spec.coupled):
            if code not in self.codes:
                raise CouplingError(f"unknown code: {code}")
        self.couplings[spec.name] = Coupling(spec, self)
        return self.couplings[spec.name]

    def uncouple(self, name: str) -> None:
        del self.couplings[name]
