"""Factorial blocks: one row per (record, template, encoding) that carries its document once.

The eight cells, the pairs cut from them and the gate over the pairs are arrays inside that row, so expanding and
gating moves no text between tasks; texts are only multiplied where a table of cells or pairs is asked for.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterlens.functions import text as T
from counterlens.functions.vectors import col as _col
from counterlens.operators.design import Design

# --- fixed values: gate thresholds and reason codes ----------------------------------------------------------------
MAX_CHAR_DELTA, MAX_WORD_DELTA, MAX_FLESCH_DELTA = 12, 3, 8.0
REASONS = ("clause_not_once", "content_differs", "clause_position", "no_contrast", "char_delta", "token_delta",
           "flesch_delta")
Renderer = Callable[[str, Column], Column]


def gate_features(text, clause) -> Column:
    """What the gate needs of one side of a pair, so that a text is read once however many pairs it is in: occurrences
    and position of the clause, a hash of the rest, and the three sizes."""
    t, c = _col(text), _col(clause)
    at = F.position(c, t)
    rest = F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), F.substring(t, at + F.length(c), F.length(t)))).otherwise(t)
    return F.struct(T.occurrences(t, c).alias("times"), at.alias("at"), F.sha2(rest, 256).alias("rest"), c.alias("clause"),
                    F.length(t).alias("chars"), T.word_count(t).alias("words"), T.flesch(t).alias("flesch"))


def surroundings(text, clause) -> Column:
    """What stands before and after the first place of the clause; null if it has none, or is empty."""
    t, c = _col(text), _col(clause)
    at = F.position(c, t)
    return F.when((at > 0) & (F.length(c) > 0), F.struct(F.substring(t, F.lit(1), at - 1).alias("before"), F.substring(t, at + F.length(c), F.length(t)).alias("after")))


def read_surroundings(parts) -> Column:
    """`surroundings` with all that `gate_features` reads in them: sizes, hash, runs of each kind and whether runs reach the clause."""
    p = _col(parts)
    before, after = p["before"], p["after"]
    # counted in a lambda: its loops over matches run compiled, whatever the size of the stage's code
    count = lambda kind: F.aggregate(F.array(before, after), F.lit(0), lambda n, x: n + F.regexp_count(x, F.lit(kind + "+")))
    runs = []
    for name, kind in T.RUNS.items():
        runs += [count(kind).alias(name), F.rlike(F.right(before, F.lit(1)), F.lit(kind)).cast("int").alias(f"{name}_before"),
                 F.rlike(F.left(after, F.lit(1)), F.lit(kind)).cast("int").alias(f"{name}_after")]
    return F.when(p.isNotNull(), F.struct(before.alias("before"), after.alias("after"), F.sha2(F.concat(before, after), 256).alias("rest"),
                                          (F.length(before) + 1).alias("at"), (F.length(before) + F.length(after)).alias("chars"), *runs))


def cell_features(cells, around) -> Column:
    """`gate_features` of every cell. Cells that are the clause between the same ``around`` (`read_surroundings`) are made up from it and
    the clause, so that a document is read once however many cells it has; any other cell is read whole."""
    a = _col(around)

    def runs(name: str, clause: Column) -> Column:
        kind = F.lit(T.RUNS[name])
        first, last = (F.rlike(side(clause, F.lit(1)), kind).cast("int") for side in (F.left, F.right))
        return a[name] + F.regexp_count(clause, F.lit(T.RUNS[name] + "+")) - a[f"{name}_before"] * first - last * a[f"{name}_after"]

    def one(c: Column) -> Column:
        text, clause = c["text"], c["clause"]
        here = (clause != "") & (text == F.concat(a["before"], clause, a["after"])) & (F.position(clause, text) == a["at"])
        counts = [runs(name, clause) for name in T.RUNS]
        times = F.when(F.contains(a["after"], clause), 1 + T.occurrences(a["after"], clause)).otherwise(1)
        made = F.struct(times.cast("int").alias("times"), a["at"].alias("at"), a["rest"].alias("rest"), clause.alias("clause"),
                        (a["chars"] + F.length(clause)).alias("chars"), counts[0].alias("words"), T.reading_ease(*counts).alias("flesch"))
        return F.when(here, made).otherwise(gate_features(text, clause))

    return F.transform(_col(cells), one)


def feature_codes(a: Column, b: Column, chars: int = MAX_CHAR_DELTA, words: int = MAX_WORD_DELTA,
                  flesch: float = MAX_FLESCH_DELTA) -> Column:
    """The reason codes a pair of `gate_features` trips, in order; empty for a clean pair."""
    once = (a["times"] == 1) & (b["times"] == 1)
    same = a["rest"] == b["rest"]
    checks = [("clause_not_once", ~once), ("content_differs", ~same), ("clause_position", same & once & (a["at"] != b["at"])),
              ("no_contrast", a["clause"] == b["clause"]), ("char_delta", F.abs(a["chars"] - b["chars"]) > chars),
              ("token_delta", F.abs(a["words"] - b["words"]) > words), ("flesch_delta", F.abs(a["flesch"] - b["flesch"]) > flesch)]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks]), lambda x: x.isNotNull())


def gated_pairs(pairs: DataFrame, **thresholds) -> DataFrame:
    """Adds ``codes`` to a table of pairs (text_a, text_b, clause_a, clause_b)."""
    f = pairs.withColumn("__a", gate_features("text_a", "clause_a")).withColumn("__b", gate_features("text_b", "clause_b"))
    return f.withColumn("codes", feature_codes(F.col("__a"), F.col("__b"), **thresholds)).drop("__a", "__b")


def blocks(records: DataFrame, design: Design, templates: list[str], render: Renderer, seed: int,
           key: str = "record_id", keep: list[str] = (), encodings: tuple[str, ...] = ("explicit", "proxy"),
           subject: str | None = None) -> DataFrame:
    """One row per (record, template, encoding): ``cells`` (levels, signs, clause, text), ``unmarked`` and ``names``.

    ``render(template, marker)`` gives the document column. Names are drawn once per block."""
    out = None
    for template in templates:
        for encoding in encodings:
            part = _block_part(records, design, template, render, seed, key, list(keep), encoding, subject)
            out = part if out is None else out.unionByName(part)
    return out


def _block_part(records, design, template, render, seed, key, keep, encoding, subject):
    names = design.drawn_names(seed, F.col(key), F.lit(template), F.lit(encoding)) if encoding == "proxy" else None
    cells = []
    for c in design.cells():
        clause = design.clause(c, encoding, names, subject)
        cells.append(F.struct(F.lit(c.key).alias("cell"), *[F.lit(s).alias(f"s{i + 1}") for i, s in enumerate(c.signs)],
                              clause.alias("clause"), render(template, clause).alias("text")))
    drawn = (F.create_map(*[x for k, v in names.items() for x in (F.lit(k), v)]) if names
             else F.create_map().cast("map<string,string>"))
    return records.select(key, *keep, F.lit(template).alias("template"), F.lit(encoding).alias("encoding"),
                          F.array(*cells).alias("cells"), render(template, F.lit("")).alias("unmarked"), drawn.alias("names"))


def pair_index(design: Design, encoding: str) -> Column:
    """The contrasts of an encoding as a literal array; ``ia`` and ``ib`` point into ``cells``."""
    at = {c.key: i for i, c in enumerate(design.cells())}
    return F.array(*[F.struct(
        F.lit(p.axis).alias("axis"), F.lit(p.suffix).alias("suffix"), F.lit(p.a.key).alias("cell_a"), F.lit(p.b.key).alias("cell_b"),
        F.lit(p.label_a).alias("label_a"), F.lit(p.label_b).alias("label_b"), F.lit(", ".join(p.held)).alias("held"),
        F.lit("; ".join(f"{k}={v}" for k, v in p.cell_map)).alias("cell_map"), F.lit(at[p.a.key]).alias("ia"), F.lit(at[p.b.key]).alias("ib"))
        for p in design.all_pairs(encoding)])


def with_pairs(block: DataFrame, design: Design, encoding: str, **thresholds) -> DataFrame:
    """Blocks of one encoding with ``pairs``: every contrast, with the gate codes it trips. Texts stay in ``cells``."""
    b = block.filter(F.col("encoding") == encoding)
    first = F.get("cells", F.lit(0))
    b = b.withColumn("around", surroundings(first["text"], first["clause"])).withColumn("around", read_surroundings("around"))
    b = b.withColumn("features", cell_features("cells", "around"))
    index = pair_index(design, encoding)
    return b.withColumn("pairs", F.transform(index, lambda p: F.struct(
        p.alias("pair"), feature_codes(F.get("features", p["ia"]), F.get("features", p["ib"]), **thresholds).alias("codes")))
    ).drop("features", "around")


def kept_blocks(paired: DataFrame) -> DataFrame:
    """Blocks all of whose pairs pass: a block is dropped whole, so the factorial stays balanced. A generator keeps the row
    or not: a filter would be pushed below the pairs and evaluate the gate's features once per pair."""
    ok = F.forall("pairs", lambda p: F.size(p["codes"]) == 0)
    return paired.withColumn("__keep", F.explode(F.when(ok, F.array(F.lit(1))))).drop("__keep")


def gate_tally(paired: DataFrame) -> DataFrame:
    """Blocks kept and dropped and failing pairs per reason code, per encoding."""
    ok = F.forall("pairs", lambda p: F.size(p["codes"]) == 0)
    base = paired.select("encoding", ok.alias("ok"), F.flatten(F.transform("pairs", lambda p: p["codes"])).alias("codes"))
    aggs = [F.count_if("ok").alias("blocks_kept"), F.count_if(~F.col("ok")).alias("blocks_dropped")]
    aggs += [F.sum(F.size(F.filter("codes", (lambda r: lambda c: c == r)(r)))).alias(r) for r in REASONS]
    return base.groupBy("encoding").agg(*aggs)


def cell_rows(block: DataFrame, keep: list[str]) -> DataFrame:
    return block.select(*keep, F.explode("cells").alias("c")).select(*keep, "c.*")


def pair_rows(block: DataFrame, design: Design, encoding: str, keep: list[str], prefix: str = "pair",
              key: str = "record_id", texts: bool = True) -> DataFrame:
    """Long pair table of one encoding, ids ``prefix-axis-encoding-template-record-suffix``; without ``texts`` only
    identifiers and labels."""
    b = block.filter(F.col("encoding") == encoding)
    index = pair_index(design, encoding)
    if texts:
        side = lambda p, i, f: F.get("cells", p[i])[f]
        index = F.transform(index, lambda p: F.struct(p.alias("pair"), *[side(p, i, f).alias(f"{f}_{i[1]}") for f in ("clause", "text") for i in ("ia", "ib")]))
    else:
        index = F.transform(index, lambda p: F.struct(p.alias("pair")))
    e = b.select(*keep, F.explode(index).alias("p"))
    ident = F.concat_ws("-", F.lit(prefix), F.col("p.pair.axis"), "encoding", "template", key, F.col("p.pair.suffix"))
    cols = [F.col(f"p.pair.{c}").alias(c) for c in ("axis", "suffix", "cell_a", "cell_b", "label_a", "label_b", "held", "cell_map")]
    if texts:
        cols += [F.col(f"p.{c}").alias(c) for c in ("clause_a", "clause_b", "text_a", "text_b")]
    return e.select(ident.alias("id"), *keep, *cols)


def decision_items(block: DataFrame, keep: list[str], responses: DataFrame, prompt: Callable[[Column], Column]) -> DataFrame:
    """Every (cell or unmarked, response) item; ``responses`` (response, paraphrase, text) is fixed by the design."""
    docs = F.concat(F.transform("cells", lambda c: F.struct(c["cell"].alias("cell"), c["text"].alias("document"))),
                    F.array(F.struct(F.lit("unmarked").alias("cell"), F.col("unmarked").alias("document"))))
    d = block.select(*keep, "paraphrase", F.explode(docs).alias("d")).select(*keep, "paraphrase", "d.*")
    return d.join(F.broadcast(responses), "paraphrase").withColumn("prompt", prompt(F.col("document"))).drop("document")
