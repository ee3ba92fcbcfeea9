"""Circuit text to relations: statements, registers, gates, qubit numbers, angles.

``texts`` is (file, text). Every step is a JVM expression. From whole texts no step shuffles;
statements that arrive on their own (a file read line by line) use the joining forms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.constants import PARAMETERIZED, THREE_QUBIT, TWO_QUBIT

# ---- fixed values: statement patterns ---------------------------------------------------
REGISTER = r"^(qreg|creg)\s+(\w+)\s*\[\s*(\d+)\s*\].*$"
#: Of a statement whose semicolon and the blanks before it are gone, so that no step has to look for its end.
GATE = r"^(\w+)(?:\(([^)]*)\))?\s+(.+)$"
OPERAND = r"(\w+)\s*\[\s*(\d+)\s*\]"
NUMBER = r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
ANGLE = rf"^([-+]?)\s*(?:({NUMBER})\s*\*\s*)?(?:(pi)|({NUMBER}))\s*(?:/\s*({NUMBER}))?$"
FACTOR = rf"(?:pi|{NUMBER})"
TERM = rf"^[-+]?{FACTOR}(?:[*/]{FACTOR})*$"
BLANKS = " \t\r\n\x0b\x0c"
MARK = "\x01"


def statements(texts: DataFrame) -> DataFrame:
    """B1: (file, line_no, stmt) without blanks, comments and headers; ``line_no`` counts from 1."""
    return _statements(texts.select("file", split_lines(F.col("text")).alias("lines")))


def _statements(lined: DataFrame) -> DataFrame:
    """``lined`` (file, lines, ...) to one row per statement, further columns kept."""
    carry = [c for c in lined.columns if c != "lines"]
    # outer, so that the planner does not split the text a second time to look for empty arrays; a null text has no statement
    lines = lined.select(*carry, F.posexplode_outer("lines").alias("line_no", "line"))
    trimmed = once(lines.select(*carry, (F.col("line_no") + 1).alias("line_no"), "line"), trimmed_line(F.col("line")), "stmt")
    return trimmed.where(~skipped()).drop("line")


def trimmed_line(line: Column) -> Column:
    """The line without blanks at its ends; trimming a set of characters is slow, so lines without any are left alone."""
    return F.when(line.rlike(r"^\s|\s$"), F.btrim(line, F.lit(BLANKS))).otherwise(line)


def split_lines(text: Column) -> Column:
    """ARRAY of the lines of a text; they may end in CR LF, LF or CR. A single character splits far faster than a pattern."""
    return F.split(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with a column whose later filters read the value instead of working it out again: no filter passes a generator."""
    return df.select(*df.columns, F.explode_outer(F.array(value)).alias(name))


def skipped() -> Column:
    """Blank lines, comments and headers."""
    s = F.col("stmt")
    return (s == "") | s.startswith("//") | s.startswith("OPENQASM") | s.startswith("include")


def match_groups(c: Column, pattern: str, n: int) -> Column:
    """ARRAY of the ``n`` groups of a whole-string pattern from one regex run; one element when there is no match."""
    return F.split(F.regexp_replace(c, pattern, MARK.join(f"${i + 1}" for i in range(n))), MARK)


def is_declaration() -> Column:
    return F.col("stmt").startswith("qreg") | F.col("stmt").startswith("creg")


def declarations(stmts: DataFrame) -> DataFrame:
    """Every register declaration, repeats included: (file, line_no, kind, name, size)."""
    parts = stmts.where(is_declaration()).select("file", "line_no", match_groups(F.col("stmt"), REGISTER, 3).alias("m"))
    return parts.where(F.size("m") == 3).select(
        "file", "line_no", F.col("m")[0].alias("kind"), F.col("m")[1].alias("name"), F.col("m")[2].cast("int").alias("size"))


def registers(stmts: DataFrame) -> DataFrame:
    """B2: (file, kind, name, size, decl_no); a register declared again keeps its place and takes the last size."""
    by_name = declarations(stmts).groupBy("file", "kind", "name").agg(
        F.max_by("size", "line_no").alias("size"), F.min("line_no").alias("first_line"))
    order = Window.partitionBy("file", "kind").orderBy("first_line")
    return by_name.select("file", "kind", "name", "size", F.row_number().over(order).alias("decl_no"))


def register_offsets(decls: DataFrame) -> DataFrame:
    """(file, offsets STRUCT<names, starts>): first qubit of each quantum register.

    Every declaration advances the offset by the register's final size, and the last declaration of a name counts.
    """
    by_file = Window.partitionBy("file").orderBy("line_no")
    everywhere = Window.partitionBy("file", "name").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sized = decls.where(F.col("kind") == "qreg").withColumn("size", F.last("size").over(everywhere))
    placed = sized.withColumn("offset", F.coalesce(F.sum("size").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = placed.groupBy("file", "name").agg(F.max_by("offset", "line_no").cast("int").alias("offset"))
    listed = last.groupBy("file").agg(F.collect_list(F.struct("name", "offset")).alias("o"))
    return listed.select("file", F.struct(F.col("o.name").alias("names"), F.col("o.offset").alias("starts")).alias("offsets"))


def drop_nonunitary(stmts: DataFrame) -> DataFrame:
    """Without lines that start with barrier or measure."""
    return stmts.where(~F.col("stmt").startswith("barrier") & ~F.col("stmt").startswith("measure"))


def operands(stmt: Column) -> Column:
    """ARRAY<STRUCT<reg, idx>> of all ``reg[idx]`` in order."""
    group = lambda i: F.regexp_extract_all(stmt, F.lit(OPERAND), F.lit(i))
    return F.arrays_zip(group(1), group(2)).cast("array<struct<reg string, idx int>>")


def gates_raw(stmts: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(file, line_no, name, args, operands) of single-line gate statements with an indexed operand.

    ``carry``: further columns to keep.
    """
    carry = carry or []
    stmt = F.col("stmt")
    ended = drop_nonunitary(stmts).where(stmt.endswith(";") & (~is_declaration() | ~stmt.rlike(REGISTER)))
    body = trimmed_line(F.substring(stmt, F.lit(1), F.length(stmt) - 1))
    cut_up = once(ended.select("file", *carry, "line_no", body.alias("stmt")), match_groups(F.col("stmt"), GATE, 3), "m")
    m = F.col("m")
    return cut_up.where((F.size(m) == 3) & m[2].rlike(OPERAND)).select(
        "file", *carry, "line_no", m[0].alias("name"), m[1].alias("args"), operands(m[2]).alias("operands"))


def eval_params(expr: Column) -> Column:
    """Value of an angle expression: terms of numbers and pi under * and /, added and subtracted; else NULL.

    Nearly all angles have the form ``[-] [num *] (pi | num) [/ num]``, which takes one regex run; others are cut up.
    """
    m = match_groups(F.btrim(expr, F.lit(BLANKS)), ANGLE, 5)
    return F.coalesce(F.element_at(F.transform(F.array(m), _angle_value), 1), _sum_of_terms(expr))


def _sum_of_terms(expr: Column) -> Column:
    # a sign opens a new term unless it starts the expression or belongs to an exponent
    plain = F.regexp_replace(expr, r"\s", "")
    terms = F.split(F.regexp_replace(plain, r"(?<=[\w.])(?<![\d.][eE])([-+])", MARK + "$1"), MARK)
    return F.aggregate(F.transform(terms, _term), F.lit(0.0), lambda a, t: a + t)


def _term(term: Column) -> Column:
    factors = F.regexp_extract_all(F.ltrim(term, F.lit("+-")), F.lit(rf"[*/]?{FACTOR}"), F.lit(0))
    number = lambda f: F.when(f.endswith("pi"), F.lit(math.pi)).otherwise(F.ltrim(f, F.lit("*/")).try_cast("double"))
    value = F.aggregate(factors, F.lit(1.0), lambda a, f: F.when(f.startswith("/"), F.try_divide(a, number(f))).otherwise(a * number(f)))
    return F.when(term.rlike(TERM), F.when(term.startswith("-"), -value).otherwise(value))


def _angle_value(m: Column) -> Column:
    """Groups of ANGLE (sign, factor, pi, number, divisor) to a value."""
    number = lambda i: m[i].try_cast("double")
    sign = F.when(m[0] == "-", -1.0).otherwise(1.0)
    base = F.when(m[2] == "pi", F.lit(math.pi)).otherwise(number(3))
    value = sign * F.coalesce(number(1), F.lit(1.0)) * base
    return F.when(F.size(m) == 5, F.when(m[4] != "", F.try_divide(value, number(4))).otherwise(value))


def _qubits_and_params(raw: DataFrame) -> DataFrame:
    """Gates from rows that carry their circuit's ``offsets``, of which the first of a name counts."""
    def qubit(o: Column) -> Column:
        at = F.array_position("offsets.names", o["reg"])
        return o["idx"] + F.coalesce(F.get("offsets.starts", (at - 1).cast("int")), F.lit(0))

    params = F.when(F.col("args") == "", F.array().cast("array<double>")).otherwise(
        F.transform(F.split("args", ","), eval_params))
    return raw.select("file", F.col("line_no").alias("seq"), "name",
                      F.transform("operands", qubit).alias("qubits"), params.alias("params"))


def global_qubits(raw: DataFrame, decls: DataFrame) -> DataFrame:
    """Gates (file, seq, name, qubits, params) with qubit = register offset + index.

    ``seq`` is the line number: it orders the gates of a circuit but may have gaps. An operand of an unknown register
    keeps its bare index. This form joins statements with declarations; ``gates`` needs no join.
    """
    return _qubits_and_params(raw.join(register_offsets(decls), "file", "left"))


def text_lines(text: Column) -> Column:
    """ARRAY of the trimmed lines of a text."""
    return F.transform(split_lines(text), trimmed_line)


def text_declarations(lines: Column, kind: str) -> Column:
    """ARRAY<STRUCT<name, size>> of all declarations of a kind in a text."""
    found = F.filter(F.transform(F.filter(lines, lambda x: x.startswith(kind)), lambda x: match_groups(x, REGISTER, 3)),
                     lambda m: F.size(m) == 3)
    return F.transform(found, lambda m: F.struct(m[1].alias("name"), m[2].cast("int").alias("size")))


def last_sizes(decls: str) -> Column:
    """The declarations with each name's last size. Takes a column name, so that the parsed array is not computed again."""
    return F.transform(decls, lambda r: F.element_at(F.filter(decls, lambda o: o["name"] == r["name"]), -1))


def gates(texts: DataFrame) -> DataFrame:
    """B6 from (file, text) without a shuffle: a text's register offsets travel with its own lines."""
    lined = texts.select("file", split_lines(F.col("text")).alias("lines"))
    trimmed = F.transform(F.filter("lines", lambda x: F.contains(x, F.lit("qreg"))), trimmed_line)
    declared = lined.withColumn("decls", text_declarations(trimmed, "qreg")).withColumn("qregs", last_sizes("decls"))
    before = lambda r, i: F.aggregate(F.slice("qregs", F.lit(1), i), F.lit(0), lambda a, o: a + o["size"])
    # the last declaration of a name counts, so the last comes first
    placed = declared.withColumn("offsets", F.struct(F.reverse("qregs.name").alias("names"), F.reverse(F.transform("qregs", before)).alias("starts")))
    return _qubits_and_params(gates_raw(_statements(placed.select("file", "offsets", "lines")), ["offsets"]))


def headers(texts: DataFrame) -> DataFrame:
    """B9 from (file, text) without a shuffle."""
    lined = texts.select("file", text_lines(F.col("text")).alias("lines"))
    found = lined.select("file", *[text_declarations(F.col("lines"), k).alias(k) for k in ("qreg", "creg")])
    both = found.select("file", *[F.array_distinct(last_sizes(k)).alias(k) for k in ("qreg", "creg")])
    total = lambda k: F.aggregate(k, F.lit(0).cast("long"), lambda a, r: a + r["size"])
    return both.select("file", total("qreg").alias("n_qubits"), total("creg").alias("n_cbits"),
                       F.size("qreg").cast("long").alias("n_qregs"), F.size("creg").cast("long").alias("n_cregs"))


def tag_arity(gates: DataFrame) -> DataFrame:
    """Adds is_2q, is_3q, is_param."""
    return gates.withColumns({"is_2q": F.col("name").isin(TWO_QUBIT), "is_3q": F.col("name").isin(THREE_QUBIT),
                              "is_param": F.col("name").isin(PARAMETERIZED)})


def circuit_header(texts_or_files: DataFrame, regs: DataFrame) -> DataFrame:
    """(file, n_qubits, n_cbits, n_qregs, n_cregs) for every file, zeros where nothing is declared."""
    is_q, is_c = F.col("kind") == "qreg", F.col("kind") == "creg"
    counted = regs.groupBy("file").agg(
        F.sum(F.when(is_q, F.col("size")).otherwise(0)).alias("n_qubits"),
        F.sum(F.when(is_c, F.col("size")).otherwise(0)).alias("n_cbits"),
        F.count(F.when(is_q, True)).alias("n_qregs"), F.count(F.when(is_c, True)).alias("n_cregs"))
    return texts_or_files.select("file").join(counted, "file", "left").na.fill(0)
