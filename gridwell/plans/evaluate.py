"""Expressions evaluated over a table or mesh.

Fields stay columns for as long as they can: arithmetic on them only builds a
bigger column. A reduction is where a plan is run; its result is a plain value.
"""

from __future__ import annotations

import dataclasses
import math
import re
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, vectors
from ..operators import binning as bn
from ..operators import histogram as hg
from ..operators import history as hs
from ..operators import mesh as ms
from ..operators import reductions as rd
from .language import Attribute, Binary, Call, ExpressionError, IfThenElse, Index, ListOf, Literal, Name, Not, parse

NAN = float("nan")


#: Functions whose first argument may be the name of a query.
OF_RESULTS = ("history", "history_range", "gradient", "gradient_range", "history_gradient", "history_gradient_range")


@dataclass
class Field:
    """A derived column; vector: its components' names."""

    column: Column
    assoc: str = "element"
    vector: tuple[str, ...] = ()
    is_bool: bool = False


class Later:
    """A value that is worked out when it is asked for."""

    def __init__(self, of):
        self.of = of


@dataclass
class Record:
    """A result with attributes."""

    kind: str
    attrs: dict[str, Any]

    def __getitem__(self, name: str):
        if name not in self.attrs:
            raise ExpressionError(f"{self.kind} has no attribute {name}; it has {', '.join(self.attrs)}")
        if isinstance(self.attrs[name], Later):
            self.attrs[name] = self.attrs[name].of()
        return self.attrs[name]


@dataclass
class Data:
    """What expressions are about: cells (or a table's rows), and perhaps vertices."""

    cells: DataFrame
    vertices: DataFrame | None = None
    keys: tuple[str, ...] = ("domain_id", "cell_id")
    state: dict[str, Any] = field(default_factory=dict)
    mesh: Any = None
    topology: str = "mesh"
    #: Other topologies of the same mesh, by name; each operator works on one.
    others: dict[str, Data] = field(default_factory=dict)
    #: What reductions of a field have said, by its table and column.
    sums: dict[Any, Any] = field(default_factory=dict)
    #: What measures of shape the cells have got, and the data they were taken of.
    measured: Any = None

    @classmethod
    def of_mesh(cls, mesh, **state) -> Data:
        return cls(mesh.cells, mesh.vertices, state=state, mesh=mesh)

    @classmethod
    def of_polyhedra(cls, solid, **state) -> Data:
        """Polyhedra as the tetrahedra that they are cut to; parent_cell is the cell of each."""
        from ..operators.polytopes import polyhedron_sides

        return cls.of_mesh(polyhedron_sides(solid), **state)

    @classmethod
    def of_topologies(cls, topologies: dict[str, Data]) -> Data:
        """Several topologies, by name; the first one is worked on unless a name or a field says another."""
        first, *rest = ((name, dataclasses.replace(d, topology=name)) for name, d in topologies.items())
        return dataclasses.replace(first[1], others=dict(rest))

    def fields(self) -> set[str]:
        return {*self.cells.columns, *(self.vertices.columns if self.vertices is not None else ())}

    def topologies(self) -> dict[str, Data]:
        return {self.topology: self, **self.others}

    def facing(self, names: set[str]) -> Data:
        """The topology that is named, or else the one that has the fields named (this
        one, if it has them); the rest go with it."""
        known = self.topologies()
        called = [n for n in known if n in names]
        asked = {n for n in names if any(n in d.fields() for d in known.values())}
        having = called or [n for n, d in known.items() if asked <= d.fields()]
        if len(called) > 1 or asked and not having:
            raise ExpressionError(f"{', '.join(sorted(names))}: one topology at a time; known are {', '.join(known)}")
        to = having[0] if having else self.topology
        if to == self.topology:
            return self
        rest = {n: dataclasses.replace(d, others={}) for n, d in known.items() if n != to}
        return dataclasses.replace(known[to], state=self.state, others=rest)

    def table(self, assoc: str) -> DataFrame:
        return self.vertices if assoc == "vertex" else self.cells

    def key_columns(self, assoc: str) -> list[str]:
        keys = ("domain_id", "vertex_id") if assoc == "vertex" else self.keys
        return [k for k in keys if k in self.table(assoc).columns]


class History:
    """Results of named queries: (name, cycle, time, value), in order of cycles."""

    def __init__(self, entries: list[tuple[str, int, float, Any]] | None = None):
        self.entries = list(entries or [])

    def add(self, name: str, cycle: int, time: float, value) -> None:
        self.entries = [e for e in self.entries if (e[0], e[1]) != (name, cycle)]
        self.entries.append((name, cycle, time, value))

    def drop_from(self, time: float) -> None:
        """Forgets what a run before a restart had already said of this time and later."""
        self.entries = [e for e in self.entries if e[2] < time]

    def of(self, name: str) -> list[tuple[int, float, Any]]:
        found = sorted((c, t, v) for n, c, t, v in self.entries if n == name)
        if not found:
            raise ExpressionError(f"no results of {name}")
        return found

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        rows = [(int(c), float(t), float(v if not isinstance(v, Record) else v["value"])) for c, t, v in self.of(name)]
        return spark.createDataFrame(rows, "cycle long, time double, value double")


def _same(a, b) -> bool:
    return isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b) or a == b


def quoted(text: str) -> set[str]:
    """What stands in quotes in a program: names of fields, topologies and results."""
    return {a or b for a, b in re.findall(r"'([^']*)'|\"([^\"]*)\"", text)}


class Evaluator:
    """Evaluates programs; results of earlier queries are known by name."""

    def __init__(self, data: Data, history: History | None = None):
        self.data, self.history = data, history or History()
        self.spark = data.cells.sparkSession
        self.names: dict[str, Any] = {}
        self.done: dict[Any, Any] = {}

    def run(self, text: str):
        """The value of a program, on the topology that it names or whose fields it names."""
        self.data = self.data.facing(quoted(text))
        statements, result = parse(text)
        self.names = {}
        for name, tree in statements:
            self.names[name] = self.value(tree)
        return self.value(result)

    def query(self, name: str, text: str):
        """Evaluates and remembers under a name, at the data's cycle and time."""
        value = self.run(text)
        self.history.add(name, int(self.data.state.get("cycle", 0)), float(self.data.state.get("time", 0.0)), value)
        return value

    def value(self, tree):
        kind = type(tree).__name__.lower()
        return getattr(self, f"on_{kind}")(tree)

    def on_literal(self, t: Literal):
        return t.value

    def on_listof(self, t: ListOf):
        return [self.value(x) for x in t.items]

    def on_name(self, t: Name):
        if t.name in self.names:
            return self.names[t.name]
        try:
            return self.history.of(t.name)[-1][2]
        except ExpressionError:
            raise ExpressionError(f"unknown name {t.name}") from None

    def on_attribute(self, t: Attribute):
        item = self.value(t.item)
        if isinstance(item, Field) and item.vector:
            if t.name not in item.vector:
                raise ExpressionError(f"a vector field has {', '.join(item.vector)}, not {t.name}")
            return Field(item.column[t.name], item.assoc)
        if not isinstance(item, Record):
            raise ExpressionError(f"{type(item).__name__} has no attributes")
        return item[t.name]

    def on_index(self, t: Index):
        items, at = self.value(t.item), self.value(t.at)
        if not isinstance(items, list) or not isinstance(at, int):
            raise ExpressionError("only arrays have indexes, and these are integers")
        if not 0 <= at < len(items):
            raise ExpressionError(f"index {at} is outside of 0 to {len(items) - 1}")
        return items[at]

    def on_not(self, t: Not):
        x = self.value(t.item)
        return Field(~x.column, x.assoc, is_bool=True) if isinstance(x, Field) else not x

    def on_ifthenelse(self, t: IfThenElse):
        c = self.value(t.condition)
        if isinstance(c, Field):
            if not c.is_bool:
                raise ExpressionError("the condition of an if must be true or false")
            a, b = self.value(t.then), self.value(t.other)
            return Field(F.when(c.column, self._column(a)).otherwise(self._column(b)), c.assoc)
        if not isinstance(c, bool):
            raise ExpressionError("the condition of an if must be true or false")
        a, b = self.value(t.then), self.value(t.other)
        if type(a) is not type(b):
            raise ExpressionError("both branches of an if must have the same type")
        return a if c else b

    def _column(self, x) -> Column:
        return x.column if isinstance(x, Field) else F.lit(x)

    def on_binary(self, t: Binary):
        a, b = self.value(t.left), self.value(t.right)
        if isinstance(a, Field) or isinstance(b, Field):
            return self._fields(t.op, a, b)
        if isinstance(a, Record) and isinstance(b, Record) and a.kind == b.kind == "vector":
            if t.op not in "+-":
                raise ExpressionError(f"vectors don't know {t.op}")
            return Record("vector", {k: a[k] + b[k] if t.op == "+" else a[k] - b[k] for k in "xyz"})
        if isinstance(a, Record) or isinstance(b, Record) or isinstance(a, list | str) or isinstance(b, list | str):
            raise ExpressionError(f"{t.op} isn't defined here")
        if t.op in ("and", "or"):
            return bool(a and b) if t.op == "and" else bool(a or b)
        if t.op in ("<", "<=", ">", ">=", "==", "!="):
            a, b = float(a), float(b)
            return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[t.op]
        whole = isinstance(a, int) and isinstance(b, int)
        if t.op == "%":
            if not whole:
                raise ExpressionError("% is for integers")
            return int(math.fmod(a, b))
        if t.op == "/":
            if whole:
                if b == 0:
                    raise ExpressionError("division of an integer by zero")
                return int(abs(a) // abs(b)) * (1 if (a < 0) == (b < 0) else -1)
            a, b = float(a), float(b)
            return a / b if b else (NAN if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1, b))
        return {"+": a + b, "-": a - b, "*": a * b}[t.op]

    def _fields(self, op: str, a, b) -> Field:
        one = a if isinstance(a, Field) else b
        if isinstance(a, Field) and isinstance(b, Field) and a.assoc != b.assoc:
            raise ExpressionError("fields of vertices and of elements don't mix")
        va, vb = (x.vector if isinstance(x, Field) else () for x in (a, b))
        x, y = self._column(a), self._column(b)
        if va or vb:
            if va != vb or op not in "+-*":
                raise ExpressionError(f"vector fields don't know {op} here")
            if op == "*":
                return Field(sum((x[c] * y[c] for c in va[1:]), x[va[0]] * y[va[0]]), one.assoc)
            parts = [(x[c] + y[c] if op == "+" else x[c] - y[c]).alias(c) for c in va]
            return Field(F.struct(*parts), one.assoc, va)
        if op in ("and", "or"):
            return Field(x & y if op == "and" else x | y, one.assoc, is_bool=True)
        x, y = numeric.number(x), numeric.number(y)
        if op in ("<", "<=", ">", ">=", "==", "!="):
            # comparisons with NaN are false, but for !=
            plain = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "==": x == y, "!=": x != y}[op]
            odd = F.isnan(x) | F.isnan(y)
            return Field(plain | odd if op == "!=" else plain & ~odd, one.assoc, is_bool=True)
        return Field({"+": x + y, "-": x - y, "*": x * y, "%": x % y}[op] if op != "/" else numeric.divide(x, y), one.assoc)

    def on_call(self, t: Call):
        if t in self.done:  # the same call on the same data, said twice
            return self.done[t]
        by_name = t.name in OF_RESULTS  # a query's name stands for all its results
        args = [a.name if by_name and not k and isinstance(a, Name) and a.name not in self.names else self.value(a) for k, a in enumerate(t.args)]
        named = {k: self.value(v) for k, v in t.named}
        if t.name not in FUNCTIONS:
            raise ExpressionError(f"unknown function {t.name}; known are {', '.join(sorted(FUNCTIONS))}")
        errors = []
        for overload in FUNCTIONS[t.name]:
            try:
                bound = overload.bind(args, named)
            except ExpressionError as e:
                errors.append(str(e))
                continue
            out = overload.function(self, **bound)
            if not by_name and self._constant(t):
                self.done[t] = out
            return out
        raise ExpressionError(f"{t.name}: no way to call it like that: " + "; ".join(errors))

    def _constant(self, tree) -> bool:
        """Whether a tree says the same whenever it is evaluated: it holds no names."""
        if isinstance(tree, Name):
            return False
        if isinstance(tree, tuple):
            return all(self._constant(x) for x in tree)
        return all(self._constant(getattr(tree, f.name)) for f in fields(tree)) if is_dataclass(tree) else True

    def materialised(self, f: Field, name: str = "__field") -> DataFrame:
        return self.data.table(f.assoc).withColumn(name, f.column)


def _is(kind: str, x) -> bool:
    if kind == "any":
        return True
    if kind == "scalar":
        return isinstance(x, int | float) and not isinstance(x, bool)
    if kind == "field":
        return isinstance(x, Field)
    if kind in ("int", "string", "bool", "list"):
        return type(x) is {"int": int, "string": str, "bool": bool, "list": list}[kind]
    if kind == "array":
        return isinstance(x, list)
    if kind == "histogram":
        return isinstance(x, Record) and x.kind == "histogram"
    return isinstance(x, Record) and x.kind == kind


@dataclass
class Overload:
    function: Any
    params: list[tuple[str, str, bool]]  # name, kind, required

    def bind(self, args: list, named: dict) -> dict:
        if len(args) > len(self.params):
            raise ExpressionError(f"{len(args)} arguments for {len(self.params)}")
        given = {n: a for (n, _, _), a in zip(self.params, args, strict=False)}
        for k, v in named.items():
            if k in given or k not in {n for n, _, _ in self.params}:
                raise ExpressionError(f"argument {k} isn't expected")
            given[k] = v
        for n, kind, required in self.params:
            if n not in given and required:
                raise ExpressionError(f"{n} is missing")
            if n in given and not any(_is(k, given[n]) for k in kind.split("|")):
                raise ExpressionError(f"{n} must be {kind}")
        return given


FUNCTIONS: dict[str, list[Overload]] = {}


def function(signature: str):
    """Registers an overload: ``name(a: kind, b: kind = )``, where ``=`` marks what can be left out."""

    def add(f):
        name, _, rest = signature.partition("(")
        params = []
        for p in filter(None, (x.strip() for x in rest.rstrip(")").split(","))):
            n, _, kind = p.partition(":")
            params.append((n.strip(), kind.replace("=", "").strip(), "=" not in kind))
        FUNCTIONS.setdefault(name, []).append(Overload(f, params))
        return f

    return add


# -- scalars, vectors and arrays


@function("abs(arg1: scalar)")
def _(ev, arg1):
    return abs(arg1)


@function("exp(arg1: scalar)")
def _(ev, arg1):
    return math.exp(arg1)


@function("pow(arg1: scalar, arg2: scalar)")
def _(ev, arg1, arg2):
    return math.pow(arg1, arg2)


@function("log(arg1: scalar)")
def _(ev, arg1):
    return math.log(arg1) if arg1 > 0 else (-math.inf if arg1 == 0 else NAN)


@function("min(arg1: scalar, arg2: scalar)")
def _(ev, arg1, arg2):
    return float(min(arg1, arg2))


@function("max(arg1: scalar, arg2: scalar)")
def _(ev, arg1, arg2):
    return float(max(arg1, arg2))


@function("nan()")
def _(ev):
    return NAN


@function("vector(arg1: scalar, arg2: scalar, arg3: scalar)")
def _(ev, arg1, arg2, arg3):
    return Record("vector", {"x": float(arg1), "y": float(arg2), "z": float(arg3)})


@function("magnitude(arg1: vector)")
def _(ev, arg1):
    return math.sqrt(sum(arg1[k] ** 2 for k in "xyz"))


for _name, _of in {"min": min, "max": max, "avg": lambda a: sum(a) / len(a), "sum": sum}.items():
    function(f"{_name}(arg1: array)")(lambda ev, arg1, of=_of: float(of(arg1)))


@function("replace(array: array, find_value: scalar, replace_value: scalar)")
def _(ev, array, find_value, replace_value):
    return [float(replace_value) if _same(float(x), float(find_value)) else x for x in array]


@function("cycle()")
def _(ev):
    return int(ev.data.state["cycle"])


@function("time()")
def _(ev):
    return float(ev.data.state["time"])


# -- fields


@function("field(name: string, component: string =)")
def _(ev, name, component=None):
    for assoc in ("element", "vertex"):
        df = ev.data.table(assoc)
        if df is not None and name in df.columns:
            kind = df.schema[name].dataType
            parts = tuple(kind.names) if kind.typeName() == "struct" else ()
            if component is not None:
                if component not in parts:
                    raise ExpressionError(f"field {name} has components {', '.join(parts)}")
                return Field(F.col(name)[component], assoc)
            return Field(F.col(name), assoc, parts)
    known = [c for a in ("element", "vertex") if ev.data.table(a) is not None for c in ev.data.table(a).columns]
    raise ExpressionError(f"unknown field {name}; known are {', '.join(known)}")


def _size(ev, name: str) -> Field:
    """The size of cells of any kind, as a field that is worked out when it is asked for."""
    column = _fresh(ev, name)
    mesh = ms.Mesh(ev.data.vertices, ev.data.cells.select("domain_id", "cell_id", "conn", *(c for c in ms.IJK if c in ev.data.cells.columns)), ev.data.mesh.axes)
    found = ms.measures(mesh).select("domain_id", "cell_id", F.col(name).alias(column))
    _store(ev, "element", ms.joined(ev.data.cells, found, ["domain_id", "cell_id"], "left"), column)
    return Field(F.col(column))


def _topology(ev, name):
    if name != ev.data.topology:
        raise ExpressionError(f"unknown topology {name}; known is {ev.data.topology}")
    cell = {c: Field(F.col(c)) for c in ("x", "y", "z") if c in ev.data.cells.columns}
    if "cell_id" in ev.data.cells.columns:
        cell["id"] = Field(F.col("cell_id"))
    if ev.data.mesh is not None and ev.data.mesh.spacing:
        spacing = [abs(s) for s in ev.data.mesh.spacing]
        cell |= {f"d{c}": Field(F.lit(s)) for c, s in zip(ev.data.mesh.axes, spacing, strict=True)}
        cell[{1: "length", 2: "area", 3: "volume"}[len(spacing)]] = Field(F.lit(math.prod(spacing)))
        if len(spacing) == 3:
            a, b, c = spacing
            cell["surface_area"] = Field(F.lit(2 * (a * b + b * c + c * a)))
    elif ev.data.mesh is not None and "conn" in ev.data.cells.columns:
        sizes = {1: "length", 2: "area", 3: "volume"}[len(ev.data.mesh.axes)]
        cell |= {name: Later(lambda name=name: _size(ev, name)) for name in (sizes, *(f"d{c}" for c in ev.data.mesh.axes))}
    attrs = {"cell": Record("cell", cell)}
    if ev.data.vertices is not None:
        vertex = {c: Field(F.col(c), "vertex") for c in ("x", "y", "z") if c in ev.data.vertices.columns}
        attrs["vertex"] = Record("vertex", vertex | {"id": Field(F.col("vertex_id"), "vertex")})
    return Record("topo", attrs)


for _name in ("topo", "topology"):
    function(f"{_name}(name: string)")(_topology)


def _extreme(greatest: bool):
    def of(ev, arg1):
        df = ev.materialised(arg1)
        place = [c for c in ("x", "y", "z") if c in df.columns]
        keys = ev.data.key_columns(arg1.assoc)
        row = rd.extreme(df, "__field", keys, greatest, place).first()
        if row is None:
            raise ExpressionError("the field has no values")
        found = row.asDict()
        position = Record("vector", {c: float(found.get(c) or 0.0) for c in "xyz"})
        element = {"domain_index": found.get("domain_id", 0), "index": found.get(keys[-1]) if keys else None, "assoc": arg1.assoc, "rank": 0}
        return Record("value_position", {"value": float(found["value"]), "position": position, "element": Record("element", element)})

    return of


function("min(arg1: field)")(_extreme(False))
function("max(arg1: field)")(_extreme(True))


_REDUCTIONS = {"sum": F.sum, "avg": F.avg, "field_nan_count": rd.nan_count, "field_inf_count": rd.inf_count}


def _reduction(name: str):
    """One scan gives all of a field's reductions; later ones of the same field are known."""

    def of(ev, arg1):
        if arg1.vector:
            raise ExpressionError("a reduction needs a scalar field")
        table, known = ev.data.table(arg1.assoc), ev.data.sums
        key = (arg1.assoc, str(arg1.column))
        if key not in known or known[key][0] is not table:
            f = numeric.number(F.col("__field"))
            known[key] = table, ev.materialised(arg1).agg(*(make(f).alias(n) for n, make in _REDUCTIONS.items())).first()
        found = known[key][1][name]
        return float(found) if found is not None else NAN

    return of


for _name in _REDUCTIONS:
    function(f"{_name}(arg1: field)")(_reduction(_name))


@function("bounds(topology: string =)")
def _(ev, topology=None):
    df = ev.data.vertices if ev.data.vertices is not None else ev.data.cells
    axes = [c for c in ("x", "y", "z") if c in df.columns]
    row = rd.bounds(df, axes).first()
    of = lambda n: Record("vector", {c: float(row[f"{n}_{c}"]) if c in axes else 0.0 for c in "xyz"})
    return Record("aabb", {"min": of("min"), "max": of("max")})


for _name, _of in {"sin": F.sin, "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": numeric.ln}.items():

    def _elementwise(ev, arg1, of=_of):
        if arg1.vector:
            raise ExpressionError("a scalar field is needed")
        return Field(of(numeric.number(arg1.column)), arg1.assoc)

    function(f"{_name}(arg1: field)")(_elementwise)


@function("pow(arg1: field, arg2: scalar)")
def _(ev, arg1, arg2):
    return Field(F.pow(numeric.number(arg1.column), F.lit(float(arg2))), arg1.assoc)


for _name, _of in {"min": F.least, "max": F.greatest}.items():

    def _pick(ev, arg1, arg2, of=_of):
        one = arg1 if isinstance(arg1, Field) else arg2
        return Field(of(numeric.number(ev._column(arg1)), numeric.number(ev._column(arg2))), one.assoc)

    function(f"{_name}(arg1: field, arg2: field|scalar)")(_pick)
    function(f"{_name}(arg1: scalar, arg2: field)")(_pick)


@function("magnitude(arg1: field)")
def _(ev, arg1):
    if not arg1.vector:
        raise ExpressionError("magnitude needs a vector field")
    return Field(F.sqrt(sum((arg1.column[c] * arg1.column[c] for c in arg1.vector[1:]), arg1.column[arg1.vector[0]] * arg1.column[arg1.vector[0]])), arg1.assoc)


@function("vector(arg1: field, arg2: field, arg3: field)")
def _(ev, arg1, arg2, arg3):
    return Field(vectors.vector(arg1.column, arg2.column, arg3.column), arg1.assoc, ("x", "y", "z"))


@function("constant_field(arg1: scalar, topo: string =, assoc: string =)")
def _(ev, arg1, topo=None, assoc="element"):
    return Field(F.lit(float(arg1)), assoc)


@function("rand()")
def _(ev):
    return Field(F.rand(0))


def _slopes(ev, f: Field, fields: dict) -> DataFrame:
    """A field's table with structs of slopes: along the lines of a regular grid, else by cells."""
    mesh = ev.data.mesh
    if mesh is not None and mesh.dims:
        return ms.slopes(ev.data.table(f.assoc), fields, mesh.axes)
    if mesh is None or f.assoc != "vertex":
        raise ExpressionError("this needs a regular grid, or a vertex field of a mesh")
    return ms.any_slopes(mesh, fields)


def _store(ev, assoc: str, df: DataFrame, name: str) -> None:
    """df in place of the data's table: it has one more column."""
    if assoc == "vertex":
        ev.data.vertices = df
    else:
        ev.data.cells = df
    if ev.data.mesh is not None:
        ev.data.mesh.vertices, ev.data.mesh.cells = ev.data.vertices, ev.data.cells


def _fresh(ev, stem: str) -> str:
    ev.made = getattr(ev, "made", 0) + 1
    return f"__{stem}{ev.made}"


@function("gradient(field: field)")
def _(ev, field):
    name = _fresh(ev, "gradient")
    _store(ev, field.assoc, _slopes(ev, field, {name: field.column}), name)
    return Field(F.col(name), field.assoc, ev.data.mesh.axes)


@function("curl(field: field)")
def _(ev, field):
    name, axes = _fresh(ev, "curl"), ev.data.mesh.axes if ev.data.mesh is not None else ()
    fields = {f"__g_{c}": field.column[c] for c in axes}
    out = _slopes(ev, field, fields).withColumn(name, ms.of_jacobian("vorticity", axes)).drop(*fields)
    _store(ev, field.assoc, out, name)
    return Field(F.col(name), field.assoc, ("z",) if len(axes) == 2 else axes)


@function("recenter(field: field, mode: string =)")
def _(ev, field, mode="toggle"):
    if mode not in ("toggle", "vertex", "element"):
        raise ExpressionError("recenter: mode is toggle, vertex or element")
    to = {"toggle": "vertex" if field.assoc == "element" else "element"}.get(mode, mode)
    if to == field.assoc:
        raise ExpressionError(f"recenter: the field is on the {to} already")
    if ev.data.mesh is None:
        raise ExpressionError("recenter needs a mesh")
    name, source = _fresh(ev, "recentred"), _fresh(ev, "source")
    mesh = ms.Mesh(ev.data.vertices, ev.data.cells, ev.data.mesh.axes)
    if to == "vertex":
        mesh.cells = mesh.cells.withColumn(source, field.column)
        made = ms.to_vertices(mesh, source, name)
        _store(ev, "vertex", ev.data.vertices.join(made, ["domain_id", "vertex_id"], "left"), name)
    else:
        mesh.vertices = mesh.vertices.withColumn(source, field.column)
        made = ms.to_cells(mesh, source, name)
        _store(ev, "element", ev.data.cells.join(made, ["domain_id", "cell_id"], "left"), name)
    return Field(F.col(name), to)


# -- histograms


def _histogram_record(h: hg.Histogram) -> Record:
    values = [r["value"] for r in h.bins.orderBy("bin").collect()]
    return Record("histogram", {"value": values, "min_val": h.min_val, "max_val": h.max_val, "num_bins": h.num_bins, "clamp": True})


@function("histogram(field: field, num_bins: int =, min_val: scalar =, max_val: scalar =)")
def _(ev, field, num_bins=256, min_val=None, max_val=None):
    try:
        return _histogram_record(hg.histogram(ev.materialised(field), "__field", num_bins, min_val, max_val))
    except ValueError as e:
        raise ExpressionError(str(e)) from None


def _changed(h: Record, values: list[float]) -> Record:
    return Record("histogram", h.attrs | {"value": values})


@function("pdf(hist: histogram)")
def _(ev, hist):
    total = sum(hist["value"])
    return _changed(hist, [v / total for v in hist["value"]])


@function("cdf(hist: histogram)")
def _(ev, hist):
    total, run, out = sum(hist["value"]), 0.0, []
    for v in hist["value"]:
        run += v
        out.append(run / total)
    return _changed(hist, out)


@function("entropy(hist: histogram)")
def _(ev, hist):
    total = sum(hist["value"])
    return -sum(v / total * math.log(v / total) for v in hist["value"] if v > 0)


@function("quantile(cdf: histogram, q: scalar, interpolation: string =)")
def _(ev, cdf, q, interpolation="linear"):
    n = cdf["num_bins"]
    if not 0 <= q <= 1 or interpolation not in hg.MODES:
        raise ExpressionError("quantile: q is from 0 to 1, interpolation one of " + ", ".join(hg.MODES))
    at = next((i for i, v in enumerate(cdf["value"]) if v >= q), n - 1)
    width = (cdf["max_val"] - cdf["min_val"]) / n
    low, below = cdf["min_val"] + at * width, cdf["value"][at - 1] if at else 0.0
    step = cdf["value"][at] - below
    part = max(0.0, (q - below) / step) if step > 0 else 0.0
    return {"lower": low, "higher": low + width, "midpoint": low + width / 2, "linear": low + part * width, "nearest": low if part < 0.5 else low + width}[interpolation]


@function("bin(hist: histogram, bin: int)")
def _(ev, hist, bin):
    if not 0 <= bin < hist["num_bins"]:
        raise ExpressionError(f"bin {bin} is outside of 0 to {hist['num_bins'] - 1}")
    return hist["value"][bin]


@function("bin(hist: histogram, val: scalar)")
def _(ev, hist, val):
    low, high, n = hist["min_val"], hist["max_val"], hist["num_bins"]
    if not low <= val <= high:
        raise ExpressionError(f"{val} is outside of the histogram")
    return hist["value"][min(int((val - low) * (n / (high - low))), n - 1)]


# -- binnings


def _axis(ev, name, bins=None, min_val=None, max_val=None, num_bins=None, clamp=False):
    if bins is not None and (min_val is not None or max_val is not None or num_bins is not None):
        raise ExpressionError("axis: bins exclude min_val, max_val and num_bins")
    try:
        return Record("axis", {"axis": bn.Axis(name, num_bins or 256, min_val, max_val, clamp, tuple(bins or ()))})
    except ValueError as e:
        raise ExpressionError(str(e)) from None


for _name in ("name", "var"):
    function(f"axis({_name}: string, bins: list =, min_val: scalar =, max_val: scalar =, num_bins: int =, clamp: bool =)")(lambda ev, n=_name, **k: _axis(ev, k.pop(n), **k))


@function("binning(reduction_var: string, reduction_op: string, bin_axes: list, empty_bin_val: scalar =, component: string =)")
def _(ev, reduction_var, reduction_op, bin_axes, empty_bin_val=0.0, component=None):
    axes = [a["axis"] for a in bin_axes]
    named = [v for v in (reduction_var, *(a.var for a in axes)) if v]
    assoc = next((s for s in ("element", "vertex") if ev.data.table(s) is not None and all(v in ev.data.table(s).columns for v in named)), None)
    if assoc is None:
        raise ExpressionError(f"binning: {', '.join(named)} aren't all fields of one association")
    try:
        b = bn.binning(ev.data.table(assoc), reduction_var, reduction_op, axes, empty_bin_val, component)
    except ValueError as e:
        raise ExpressionError(str(e)) from None
    values = Later(lambda: [r["value"] for r in b.grid.orderBy("bin").collect()])  # the grid stays on the cluster until then
    return Record("binning", {"value": values, "binning": b, "reduction_op": reduction_op, "reduction_var": reduction_var, "association": assoc})


def _bin_record(row) -> Record:
    return Record("bin", {k: row[k] for k in ("min", "max", "center", "value")})


@function("bin(binning: binning, index: int)")
def _(ev, binning, index):
    try:
        return _bin_record(bn.bin_at(binning["binning"], index).first())
    except ValueError as e:
        raise ExpressionError(str(e)) from None


@function("point_and_axis(binning: binning, axis: string, threshold: scalar, point: scalar, miss_value: scalar =, direction: int =)")
def _(ev, binning, axis, threshold, point, miss_value=NAN, direction=1):
    return _bin_record(bn.point_and_axis(binning["binning"], threshold, point, miss_value, direction).first())


@function("max_from_point(binning: binning, axis: string, point: scalar)")
def _(ev, binning, axis, point):
    row = bn.max_from_point(binning["binning"], point).first()
    return Record("value_position", {"value": row["value"], "position": Record("vector", {c: row["distance"] if c == axis else 0.0 for c in "xyz"})})


@function("binning_value(binning: binning, default_val: scalar =, topo: string =, assoc: string =)")
def _(ev, binning, default_val=0.0, topo=None, assoc=None):
    name, where = _fresh(ev, "painted"), assoc or binning["association"]
    _store(ev, where, bn.painted(ev.data.table(where), binning["binning"], name, default_val), name)
    return Field(F.col(name), where)


@function("lineout(samples: int, start: vector, end: vector, fields: list =, empty_val: scalar =)")
def _(ev, samples, start, end, fields=None, empty_val=0.0):
    mesh = ev.data.mesh
    if mesh is None:
        raise ExpressionError("lineout needs a mesh")
    known = {"i", "j", "k", "x", "y", "z", "conn", *ev.data.keys}
    fields = fields or [c for c in mesh.cells.columns if c not in known]
    rows = ms.lineout(mesh, samples, [start[c] for c in mesh.axes], [end[c] for c in mesh.axes], fields, empty_val).orderBy("sample").collect()
    return Record("array", {"coordinates": [[r[c] for c in mesh.axes] for r in rows], "vars": {f: [r[f] for r in rows] for f in fields}})


# -- history


def _results(ev, name: str) -> DataFrame:
    return ev.history.table(ev.spark, name)


@function("history(expr_name: string, relative_index: int =, absolute_index: int =)")
def _(ev, expr_name, relative_index=None, absolute_index=None):
    found = [v for _, _, v in ev.history.of(expr_name)]
    if (relative_index is None) == (absolute_index is None):
        raise ExpressionError("history: give either relative_index or absolute_index")
    if absolute_index is not None:
        if not 0 <= absolute_index < len(found):
            raise ExpressionError(f"history: index {absolute_index} is outside of 0 to {len(found) - 1}")
        return found[absolute_index]
    if relative_index < 0:
        raise ExpressionError("history: an index can't be negative")
    return found[max(0, len(found) - 1 - relative_index)]


_ENDS = "first_relative_index: int =, last_relative_index: int =, first_absolute_index: int =, last_absolute_index: int =, first_absolute_time: scalar =, last_absolute_time: scalar =, first_absolute_cycle: int =, last_absolute_cycle: int ="


@function(f"history_range(expr_name: string, {_ENDS})")
def _(ev, expr_name, **ends):
    try:
        return hs.collected(hs.between(_results(ev, expr_name), **ends)).first()["values"]
    except ValueError as e:
        raise ExpressionError(str(e)) from None


def _gradient(ev, expr_name, window_length=1, unit="index"):
    try:
        return hs.gradient(_results(ev, expr_name), window_length, unit).first()["gradient"]
    except ValueError as e:
        raise ExpressionError(str(e)) from None


def _gradient_range(ev, expr_name, **ends):
    try:
        return [r["gradient"] for r in hs.successive(_results(ev, expr_name), **ends).orderBy("cycle").collect()]
    except ValueError as e:
        raise ExpressionError(str(e)) from None


for _name in ("gradient", "history_gradient"):
    function(f"{_name}(expr_name: string, window_length: scalar =, unit: string =)")(_gradient)
for _name in ("gradient_range", "history_gradient_range"):
    function(f"{_name}(expr_name: string, {_ENDS})")(_gradient_range)


def plain(value):
    """A result as nested dicts, lists and numbers."""
    if isinstance(value, Record):
        return {k: plain(value[k]) for k in list(value.attrs) if not isinstance(value.attrs[k], bn.Binning)}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value if not isinstance(value, Field) else "field"
