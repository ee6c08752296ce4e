"""Solvers of the puzzle families, from columns of their parameters to columns of their answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.session import cut

#: Phases of the moon in turn, and colours of indicator strips by solution.
MOON = ["new moon", "waxing crescent", "first quarter", "waxing gibbous", "full moon", "waning gibbous", "last quarter", "waning crescent"]
INDICATOR = {"lemon juice": "red", "vinegar": "orange", "pure water": "green", "soap": "blue", "baking soda": "purple"}


def sudoku4(grid: Column, row: Column, col: Column) -> Column:
    """The digit of an empty cell (null) of a 4 x 4 grid, an array of 16; null unless exactly one fits."""
    cell = lambda r, c: F.element_at(grid, (r * 4 + c + 1).cast("int"))
    top, left = F.floor(row / 2) * 2, F.floor(col / 2) * 2
    used = [cell(row, F.lit(i)) for i in range(4)] + [cell(F.lit(i), col) for i in range(4)] + [cell(top + i, left + j) for i in range(2) for j in range(2)]
    free = F.array_except(F.array(*(F.lit(d) for d in (1, 2, 3, 4))), F.array(*used))
    return F.when(F.size(free) == 1, F.element_at(free, 1))


def arithmetic_chain(start: Column, ops: Column) -> Column:
    """All values of a chain of {op: mul, add or sub, value}, the start first."""
    def step(values: Column, o: Column) -> Column:
        last = F.element_at(values, -1)
        return F.concat(values, F.array(F.when(o["op"] == "mul", last * o["value"]).when(o["op"] == "add", last + o["value"]).when(o["op"] == "sub", last - o["value"])))

    return F.aggregate(ops, F.array(start.cast("bigint")), step)


def balance(left: Column, right: Column, missing: Column) -> Column:
    """The weight that is missing on the side named; null unless positive."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    value = F.when(missing == "left", total(right) - total(left)).otherwise(total(left) - total(right))
    return F.when(value > 0, value)


def clock(hour: Column, minute: Column, add: Column) -> Column:
    """H:MM of a twelve-hour clock some hours on."""
    h = F.pmod(F.pmod(hour, F.lit(12)) + add, F.lit(12))
    return F.format_string("%d:%02d", F.when(h == 0, 12).otherwise(h).cast("int"), minute.cast("int"))


def mirror(x: Column, axis: Column) -> Column:
    return 2 * axis - x


def remove_block(stack: Column, row: Column) -> Column:
    """A stack without the block at an index from 0."""
    return F.filter(stack, lambda _, i: i != row)


def moon(start: Column) -> Column:
    """The phase three steps on."""
    return F.element_at(F.array(*map(F.lit, MOON)), (F.pmod(start + 3, F.lit(8)) + 1).cast("int"))


def indicator(solution: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, color in INDICATOR.items():
        out = F.when(solution == name, color).otherwise(out)
    return out


def food_edge(chain: Column, index: Column) -> Column:
    """The right arrow at an index from 0, as from->to."""
    return F.concat(F.element_at(chain, (index + 1).cast("int")), F.lit("->"), F.element_at(chain, (index + 2).cast("int")))


def third_angle(a: Column, b: Column) -> Column:
    return 180 - a - b


def swap_next(values: Column, i: Column) -> Column:
    """The values with those at i and i + 1, from 0, exchanged."""
    return F.transform(values, lambda x, k: F.when(k == i, F.element_at(values, (i + 2).cast("int"))).when(k == i + 1, F.element_at(values, (i + 1).cast("int"))).otherwise(x))


def shaded(rows: Column, cols: Column, p: Column, q: Column) -> Column:
    return F.floor(rows * cols * p / q).cast("bigint")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("graph", F.col("a").alias("at"), F.col("b").alias("to"), "w").unionByName(edges.select("graph", F.col("b").alias("at"), F.col("a").alias("to"), "w"))


def _grown(front: DataFrame, both: DataFrame) -> DataFrame:
    """Simple paths one edge longer."""
    f, e = front.alias("f"), both.alias("e")
    met = f.join(e, (F.col("f.graph") == F.col("e.graph")) & (F.col("f.node") == F.col("e.at"))).filter(~F.array_contains("f.path", F.col("e.to")))
    return met.select("f.graph", F.col("e.to").alias("node"), F.concat("f.path", F.array("e.to")).alias("path"), (F.col("f.distance") + F.col("e.w")).alias("distance"))


def shortest_paths(edges: DataFrame, start: str, goal: str) -> DataFrame:
    """(graph, path, distance) of each graph of undirected edges (graph, a, b, w): the shortest simple path; of equals the first in order.

    Paths grow by one joined edge each round, by graph, and of paths to the same node only the best goes on, if it is better
    than the best known; it ends when no path is, which is after the longest best path, whatever its length.
    """
    both = cut(_both_ways(edges))
    best = cut(edges.select("graph").distinct().select("graph", F.lit(start).alias("node"), F.array(F.lit(start)).alias("path"), F.lit(0).cast("bigint").alias("distance")))
    front = best
    while not front.isEmpty():
        new = _grown(front, both).groupBy("graph", "node").agg(F.min(F.struct("distance", "path")).alias("m"))
        old = best.select("graph", "node", F.struct("distance", "path").alias("o"))
        better = new.join(old, ["graph", "node"], "left").filter(F.col("o").isNull() | (F.col("m") < F.col("o")))
        front = cut(better.select("graph", "node", "m.path", "m.distance"), fresh=True)
        best = cut(best.join(front.select("graph", "node"), ["graph", "node"], "left_anti").unionByName(front), fresh=True)
    return best.filter(F.col("node") == goal).select("graph", "path", "distance")


def simple_paths(edges: DataFrame, start: str, goal: str) -> DataFrame:
    """(graph, path, distance): all simple paths from start to goal; as many as a graph has, so graphs are to be small."""
    both = cut(_both_ways(edges))
    front = edges.select("graph").distinct().select("graph", F.lit(start).alias("node"), F.array(F.lit(start)).alias("path"), F.lit(0).cast("bigint").alias("distance"))
    done = front.filter(F.col("node") == goal)
    front = cut(front.filter(F.col("node") != goal))
    while not front.isEmpty():
        front = cut(_grown(front, both), fresh=True)
        done = done.unionByName(front.filter(F.col("node") == goal))
        front = front.filter(F.col("node") != goal)
    return done.select("graph", "path", "distance")


def longer_path(paths: DataFrame) -> DataFrame:
    """(graph, path, distance): of each graph the best path that is longer than the shortest, for a wrong answer; of equals the first in order."""
    least = paths.groupBy("graph").agg(F.min("distance").alias("_d"))
    return paths.join(least, "graph").filter("distance > _d").groupBy("graph").agg(F.min(F.struct("distance", "path")).alias("m")).select("graph", "m.path", "m.distance")


def partition(total: Column, parts: int, seed: Column) -> Column:
    """A split of a total into `parts` whole numbers from 1 to 9, in an order drawn from the seed; null if there is none."""
    r = lambda i: F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(1 << 20))
    values, left = F.array().cast("array<bigint>"), total.cast("bigint")
    for i in range(parts):
        rest = parts - i - 1
        low, high = F.greatest(F.lit(1), left - 9 * rest), F.least(F.lit(9), left - rest)
        value = low + F.pmod(r(i), high - low + 1) if rest else left
        values, left = F.concat(values, F.array(value.cast("bigint"))), left - value
    order = F.transform(F.array_sort(F.transform(values, lambda v, i: F.struct(F.xxhash64(seed, i, F.lit("order")).alias("o"), v.alias("v")))), lambda x: x["v"])
    return F.when((total >= parts) & (total <= 9 * parts), order)


#: What a closed circuit shows.
CIRCUIT = {"switch": "closed", "bulb": "on"}


def circuit() -> Column:
    return F.struct(*(F.lit(v).alias(k) for k, v in CIRCUIT.items()))


PARAMETERS = """struct<grid:array<int>,row:int,col:int,start:bigint,ops:array<struct<op:string,value:bigint>>,left:array<bigint>,right:array<bigint>,missing:string,
answer:string,hour:int,minute:int,add:int,x:bigint,axis:bigint,stack:array<string>,solution:string,chain:array<string>,index:int,a:int,b:int,array:array<bigint>,rows:int,cols:int,p:int,q:int,order:array<string>,phase:int>"""


def solve(solver: Column, params: Column) -> Column:
    """The answer of the puzzle that `solver` names, as text, from its parameters (a struct of PARAMETERS); null for an unknown name.

    Paths of graphs are solved by `shortest_paths`, as they need joins.
    """
    text = lambda c: c.cast("string")
    joined = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ", ")
    by = {
        "sudoku4": text(sudoku4(params["grid"], params["row"], params["col"])), "arithmetic_chain": text(F.element_at(arithmetic_chain(params["start"], params["ops"]), -1)),
        "balance_scale": text(balance(params["left"], params["right"], params["missing"])), "sequence_pattern": params["answer"], "clock_arithmetic": clock(params["hour"], params["minute"], params["add"]),
        "mirror_reflection": text(mirror(params["x"], params["axis"])), "block_stack_view": joined(remove_block(params["stack"], params["index"])), "circuit_bulb": F.lit(CIRCUIT["bulb"]),
        "ph_indicator": indicator(params["solution"]), "food_chain": food_edge(params["chain"], params["index"]), "geometry_angle": text(third_angle(params["a"], params["b"])),
        "sorting_step": joined(swap_next(params["array"], params["index"])), "fraction_shade": text(shaded(params["rows"], params["cols"], params["p"], params["q"])),
        "process_order": F.array_join(params["order"], ", "), "moon_phase": moon(params["phase"]),
    }
    out = F.lit(None).cast("string")
    for name, answer in by.items():
        out = F.when(solver == name, answer).otherwise(out)
    return out


#: Questions of the checks of two puzzles.
BULB, STRIP = "What color is the bulb, yellow or gray? Answer one word.", "What color is the indicator strip? Answer one word."


def verifier_error(sub_task: Column, params: Column, checks: Column, wrong: Column) -> Column:
    """What is wrong with the checks (question, expected_answer) of a puzzle, or null; wrong: what its negative shows, as text. Puzzles without a rule have no error."""
    first = F.try_element_at(checks, F.lit(1))
    q, e = first["question"], first["expected_answer"]
    solved = solve(sub_task, params)
    arrows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(params["chain"]) - 1, F.lit(1))), lambda i: F.concat(F.lit("Is there an arrow pointing from "), F.try_element_at(params["chain"], i), F.lit(" to "), F.try_element_at(params["chain"], i + 1), F.lit("? Answer yes or no.")))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(sub_task == "sorting_step", F.when(no(e == solved), "answer").when(no(F.array_join(F.transform(params["array"], lambda v: v.cast("string")), ", ") != solved), "no_swap"))
        .when(sub_task == "geometry_angle", F.when(no(e == solved), "answer").when(e == wrong, "negative"))
        .when(sub_task == "food_chain", F.when(no(F.transform(checks, lambda c: c["question"]) == arrows) | F.exists(checks, lambda c: no(c["expected_answer"] == "yes")), "answer").when((params["index"].cast("string") == wrong) & (F.size(params["chain"]) > 2), "negative"))
        .when(sub_task == "circuit_bulb", F.when(no((q == BULB) & (e == "yellow")), "answer"))
        .when(sub_task == "ph_indicator", F.when(no(q == STRIP), "question").when(no(e == solved), "answer"))
        .when(sub_task == "process_order", F.when(no(e == solved), "answer"))
    )


def draw(seed: Column, name: str, low: int, high: int) -> Column:
    """A whole number from low to high, drawn from a seed and a name."""
    return (F.pmod(F.xxhash64(seed, F.lit(name)), F.lit(high - low + 1)) + low).cast("int")


def puzzles(spark: SparkSession, count: int, seed: int = 1) -> DataFrame:
    """(puzzle, solver, params, answer): `count` puzzles, the families in turn, each with drawn parameters and its answer.

    Every value is a function of seed and number, so any row can be made again, anywhere.
    """
    n = F.xxhash64(F.lit(seed), "id")
    d = lambda name, low, high: draw(n, name, low, high)
    kind = StructType.fromDDL(PARAMETERS[7:-1].replace("\n", ""))
    def params(**given: Column) -> Column:
        return F.struct(*((given[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields))

    base = F.array(*map(F.lit, [1, 2, 3, 4, 3, 4, 1, 2, 2, 1, 4, 3, 4, 3, 2, 1]))
    turn = F.transform(base, lambda v: F.pmod(v + d("turn", 0, 3), F.lit(4)) + 1)
    row, col = d("row", 0, 3), d("col", 0, 3)
    grid = F.transform(turn, lambda v, i: F.when(i != row * 4 + col, v))
    steps = F.array(*(F.struct(F.element_at(F.array(F.lit("mul"), F.lit("add"), F.lit("sub")), d(f"op{i}", 1, 3)).alias("op"), d(f"value{i}", 2, 9).cast("bigint").alias("value")) for i in range(3)))
    total = d("total", 8, 24)
    names = ["grass", "rabbit", "fox", "eagle"]
    step = d("step", 2, 7)
    made = {
        "sudoku4": params(grid=grid, row=row, col=col), "arithmetic_chain": params(start=d("start", 2, 20), ops=steps), "balance_scale": params(left=partition(total, 3, n), right=F.array(F.lit(3).cast("bigint")), missing=F.lit("right")),
        "sequence_pattern": params(answer=(d("start", 1, 9) + step * 4).cast("string")), "clock_arithmetic": params(hour=d("hour", 1, 12), minute=d("minute", 0, 11) * 5, add=d("add", 1, 11)), "mirror_reflection": params(x=d("x", 1, 9), axis=d("axis", 10, 15)),
        "block_stack_view": params(stack=F.array(*map(F.lit, ["red", "blue", "green", "yellow"])), index=d("index", 0, 3)), "circuit_bulb": params(), "ph_indicator": params(solution=F.element_at(F.array(*map(F.lit, INDICATOR)), d("solution", 1, len(INDICATOR)))),
        "food_chain": params(chain=F.array(*map(F.lit, names)), index=d("index", 0, len(names) - 2)), "geometry_angle": params(a=d("a", 30, 80), b=d("b", 30, 80)), "sorting_step": params(array=F.array(*(d(f"v{i}", 1, 99) for i in range(5))), index=d("index", 0, 3)),
        "fraction_shade": params(rows=d("rows", 2, 5), cols=d("cols", 2, 5), p=d("p", 1, 3), q=F.lit(4)), "process_order": params(order=F.array(*map(F.lit, ["seed", "sprout", "bud", "flower"]))), "moon_phase": params(phase=d("phase", 0, 7)),
    }
    solver, chosen = F.lit(None).cast("string"), F.lit(None).cast(kind)
    for i, (name, p) in enumerate(made.items()):
        at = F.pmod("id", F.lit(len(made))) == i
        solver, chosen = F.when(at, name).otherwise(solver), F.when(at, p).otherwise(chosen)
    return spark.range(count).select(F.col("id").alias("puzzle"), solver.alias("solver"), chosen.alias("params")).withColumn("answer", solve(F.col("solver"), F.col("params")))


def disagreements(df: DataFrame, solved: str, truth: str, key: str) -> DataFrame:
    """(key): rows whose answer, solved anew, isn't the stored one."""
    return df.filter(~F.col(solved).eqNullSafe(F.col(truth))).select(key)
