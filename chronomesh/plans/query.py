"""A small pattern query language over temporal graphs.

    MATCH (a)-[:REL]->(b) [WHERE pred {AND pred}] RETURN item {, item}
    CALL name.name(arg {, arg}) [YIELD id {, id}] [RETURN id {, id}]
    pred: time_window(s, e) | spatial_sphere([x, y, z], r)
    arg:  int | name: number | pred

Windows and spheres apply to both ends and the edge.  The text becomes a request, the request a DataFrame plan.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.operators import traversal as T
from chronomesh.plans.model import Context, Graph, Sphere, Window

LEXEME = re.compile(r"\s*(?:(-?[0-9]+\.[0-9]+|-?[0-9]+)|([A-Za-z_][A-Za-z_0-9]*)|(->|[()\[\],.:\-]))")


class QueryError(ValueError):
    pass


@dataclass
class Request:
    kind: str  # "match" or a procedure's name
    relation: str = ""
    returns: list[str] = field(default_factory=list)
    numbers: list[float] = field(default_factory=list)
    named: dict[str, float] = field(default_factory=dict)
    context: Context = field(default_factory=Context)
    ends: tuple[str, str] = ("a", "b")


class Parser:
    def __init__(self, text: str):
        self.parts, at = [], 0
        while text[at:].strip():
            m = LEXEME.match(text, at)
            if not m:
                raise QueryError(f"unexpected {text[at:at + 10]!r}")
            self.parts.append(m[1] or m[2] or m[3])
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.parts[self.at] if self.at < len(self.parts) else ""

    def take(self, *wanted: str) -> str:
        got = self.peek()
        if not got or wanted and got.upper() not in wanted:
            raise QueryError(f"expected {' or '.join(wanted) or 'more'}, got {got or 'the end'!r}")
        self.at += 1
        return got

    def maybe(self, word: str) -> bool:
        if self.peek().upper() == word:
            self.at += 1
            return True
        return False

    def number(self) -> float:
        got = self.take()
        try:
            return int(got) if re.fullmatch("-?[0-9]+", got) else float(got)
        except ValueError:
            raise QueryError(f"expected a number, got {got!r}") from None

    def parse(self) -> Request:
        request = self.match() if self.take("MATCH", "CALL").upper() == "MATCH" else self.call()
        if self.peek():
            raise QueryError(f"unexpected {self.peek()!r}")
        return request

    def match(self) -> Request:
        self.take("(")
        a = self.take()
        for want in (")", "-", "[", ":"):
            self.take(want)
        relation = self.take()
        for want in ("]", "->", "("):
            self.take(want)
        b = self.take()
        self.take(")")
        request = Request("match", relation, ends=(a, b))
        if self.maybe("WHERE"):
            self.predicate(request)
            while self.maybe("AND"):
                self.predicate(request)
        self.take("RETURN")
        request.returns = self.items()
        for item in request.returns:
            if item.split(".")[0] not in (a, b):
                raise QueryError(f"unknown variable in {item!r}")
        return request

    def call(self) -> Request:
        name = self.take()
        while self.maybe("."):
            name += "." + self.take()
        request = Request(name)
        self.take("(")
        while self.peek() != ")":
            word = self.peek()
            if word in ("time_window", "spatial_sphere"):
                self.predicate(request)
            elif re.fullmatch("[A-Za-z_].*", word):
                self.take()
                self.take(":")
                request.named[word] = self.number()
            else:
                request.numbers.append(self.number())
            if not self.maybe(","):
                break
        self.take(")")
        if self.maybe("YIELD"):
            request.returns = self.items()
        if self.maybe("RETURN"):
            request.returns = self.items()
        return request

    def items(self) -> list[str]:
        out = []
        while True:
            item = self.take()
            if self.maybe("."):
                item += "." + self.take()
            out.append(item)
            if not self.maybe(","):
                return out

    def predicate(self, request: Request) -> None:
        from dataclasses import replace

        name = self.take()
        self.take("(")
        if name == "time_window":
            start = self.number()
            self.take(",")
            request.context = replace(request.context, window=Window(int(start), int(self.number())))
        elif name == "spatial_sphere":
            self.take("[")
            x = self.number()
            self.take(",")
            y = self.number()
            self.take(",")
            z = self.number()
            self.take("]")
            self.take(",")
            request.context = replace(request.context, sphere=Sphere(x, y, z, self.number()))
        else:
            raise QueryError(f"unknown predicate {name!r}")
        self.take(")")


def match(graph: Graph, request: Request) -> DataFrame:
    own = graph.within(request.context)
    edges = own.edges.select("src", "dst")
    a, b = request.ends
    columns = []
    props = {}
    for item in request.returns:
        var, _, prop = item.partition(".")
        end = "src" if var == a else "dst"
        if prop:
            props.setdefault(end, []).append(prop)
            columns.append(F.col(f"{end}_{prop}").alias(f"{var}_{prop}"))
        else:
            columns.append(F.col(end).alias(var))
    for end, names in props.items():  # nodes are joined only for what is asked of them
        fixed = {"id", "x", "y", "z", "begin_ts", "end_ts"}
        part = own.nodes.select(
            F.col("id").alias(end), *[(F.col(n) if n in fixed else F.col("props")[n]).alias(f"{end}_{n}") for n in dict.fromkeys(names)]
        )
        edges = edges.join(part, end)
    return edges.select(columns)


def _route(graph: Graph, r: Request) -> dict[str, DataFrame]:
    start, goal = map(int, r.numbers[:2])
    found = T.earliest_arrival(graph, start, goal, int(r.named["departure"]), r.context)
    return {"path": found.select(F.col("path"), F.col("departure").alias("departure_time"), F.col("arrival").alias("arrival_time"), "duration")}


def _impact(graph: Graph, r: Request) -> dict[str, DataFrame]:
    return {"reachable": T.reachable_in_order(graph, int(r.numbers[0]), r.context).orderBy("rank").select("node")}


def _bottlenecks(graph: Graph, r: Request) -> dict[str, DataFrame]:
    points, bridges = T.cut_points(graph, r.context)
    return {"articulation_points": points, "bridges": bridges}


def _propagate(graph: Graph, r: Request) -> dict[str, DataFrame]:
    got, rest = T.signal(graph, int(r.numbers[0]), int(r.named["departure"]), r.context)
    return {"reachable": got, "unreachable": rest}


def _astar(graph: Graph, r: Request) -> dict[str, DataFrame]:
    return {"path": T.cheapest_path(graph, int(r.numbers[0]), int(r.numbers[1]), r.context)}


def _strong(graph: Graph, r: Request) -> dict[str, DataFrame]:
    return {"components": T.strong_components(graph, r.context)}


#: the last two are this engine's own additions
PROCEDURES = {
    "db.route.temporal": _route, "db.impact.radius": _impact, "db.resilience.bottlenecks": _bottlenecks,
    "db.signal.propagate": _propagate, "db.route.astar": _astar, "db.components.strong": _strong,
}
#: yields that are columns of a procedure's one frame and not frames of their own
COLUMNS = {"path", "arrival_time", "duration", "departure_time", "total_cost"}


def run(graph: Graph, text: str) -> dict[str, DataFrame]:
    """Frames by name: "rows" of a MATCH, or what a procedure yields."""
    request = Parser(text).parse()
    if request.kind == "match":
        return {"rows": match(graph, request)}
    if request.kind not in PROCEDURES:
        raise QueryError(f"unknown procedure {request.kind!r}")
    try:
        found = PROCEDURES[request.kind](graph, request)
    except (IndexError, KeyError, ValueError) as e:
        raise QueryError(f"wrong arguments for {request.kind}: {e}") from e
    if not request.returns:
        return found
    if set(request.returns) <= COLUMNS:
        (frame,) = found.values()
        return {"rows": frame.select(request.returns)}
    try:
        return {k: found[k] for k in request.returns}
    except KeyError as e:
        raise QueryError(f"{request.kind} does not yield {e}") from e


def envelope(demo: str, description: str, results: list[tuple[str, dict[str, DataFrame]]]) -> str:
    """Pretty JSON of small results, for people: {demo, description, queries: [{query, result}]}."""
    queries = [
        {"query": q, "result": {k: [r.asDict(recursive=True) for r in df.collect()] for k, df in frames.items()}} for q, frames in results
    ]
    return json.dumps({"demo": demo, "description": description, "queries": queries}, indent=2, default=str)
