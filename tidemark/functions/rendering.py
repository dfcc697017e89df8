"""Expressions as Spark SQL text over slots. Functions are Spark's own; only names and forms that differ are translated."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .tree import (
    Between, Binary, Call, Case, Cast, Extract, InList, Is, Like, Literal, Node, Quantified, Row, Slot, SortKey, Star, Unary,
)

# Types and functions that have another name in Spark.
TYPES = {
    "int4": "int", "integer": "int", "int8": "bigint", "int2": "smallint", "text": "string", "varchar": "string", "char": "string", "bpchar": "string",
    "float8": "double", "float4": "float", "real": "float", "numeric": "decimal", "bool": "boolean", "bytea": "binary", "timestamptz": "timestamp",
}
FUNCTIONS = {
    "cardinality": "size", "array_length": "size", "strpos": "instr", "btrim": "trim", "char_length": "length", "character_length": "length", "octet_length": "octet_length",
    "bool_and": "bool_and", "every": "every", "array_agg": "collect_list", "trunc": "trunc", "substr": "substring", "jsonb_extract_path_text": "get_json_object",
    "log": "log10", "to_number": "to_number", "string_to_array": "split", "regexp_matches": "regexp_extract_all", "variance": "var_samp", "stddev": "stddev_samp",
}


def quoted(slot: str) -> str:
    return f"`{slot}`"


def type_name(kind: str) -> str:
    if kind.endswith("[]"):
        return f"array<{type_name(kind[:-2])}>"
    m = re.fullmatch(r"(\w+)(\(.*\))?", kind)
    base, size = m[1], m[2] or ""
    name = TYPES.get(base, base)
    return name + (size if name == "decimal" else "" if name != "decimal" else "")


class Renderer:
    """Renders over a relation, whose types it asks Spark for where a form depends on them."""

    def __init__(self, df: DataFrame):
        self.df = df

    def kind(self, node: Node) -> str:
        return self.df.selectExpr(f"{self(node)} AS x").schema[0].dataType.simpleString()

    def __call__(self, node: Node) -> str:
        r = self
        match node:
            case Slot():
                return quoted(node.name)
            case Literal():
                if node.text.startswith("'"):
                    return "'" + node.text[1:-1].replace("\\", "\\\\").replace("''", "\\'") + "'"
                return node.text + "D" if re.search(r"[eE]", node.text) and node.text[0].isdigit() else node.text
            case Star():
                return "*"
            case Unary():
                return f"({node.op} {r(node.x)})"
            case Binary():
                return self.binary(node)
            case Is():
                return f"({r(node.x)} IS {'NOT ' * node.negated}{node.what})"
            case Between():
                return f"({r(node.x)} {'NOT ' * node.negated}BETWEEN {r(node.low)} AND {r(node.high)})"
            case InList():
                return f"({r(node.x)} {'NOT ' * node.negated}IN ({', '.join(map(r, node.items))}))"
            case Like():
                return f"({r(node.x)} {'NOT ' * node.negated}{node.kind} {r(node.pattern)})"
            case Quantified():
                test = {"~": "x RLIKE y"}.get(node.op, f"x {node.op} y")
                return f"{'forall' if node.every else 'exists'}({r(node.array)}, y -> {test.replace('x', r(node.x), 1)})"
            case Case():
                operand = f" {r(node.operand)}" if node.operand else ""
                return f"CASE{operand}{''.join(f' WHEN {r(a)} THEN {r(b)}' for a, b in node.branches)}{f' ELSE {r(node.otherwise)}' if node.otherwise else ''} END"
            case Cast():
                return self.cast(node)
            case Extract():
                field = {"dow": "DAYOFWEEK", "isodow": "DAYOFWEEK_ISO"}.get(node.field, node.field)
                value = f"extract({field} FROM {r(node.x)})"
                return f"({value} - 1)" if node.field == "dow" else value
            case Row():
                return f"struct({', '.join(map(r, node.items))})"
            case Call():
                return self.call(node)
        raise TypeError(f"{type(node).__name__} has no rendering")

    def cast(self, node: Cast) -> str:
        kind = type_name(node.kind)
        if kind.startswith("array<") and isinstance(node.x, Literal) and node.x.text.startswith("'{"):
            inner = node.x.text[2:-2].strip()
            element = kind[6:-1]
            items = [f"CAST({'NULL' if x.strip().upper() == 'NULL' else chr(39) + x.strip().strip(chr(34)) + chr(39)} AS {element})" for x in inner.split(",")] if inner else []
            return f"CAST(array({', '.join(items)}) AS {kind})"
        x = self(node.x)
        if kind in ("tinyint", "smallint", "int", "bigint") and not isinstance(node.x, Literal):
            # A fraction is rounded, not cut off.
            source = self.kind(node.x)
            x = f"rint({x})" if source in ("double", "float") else f"round({x})" if source.startswith("decimal") else x
        return f"CAST({x} AS {kind})"

    def binary(self, node: Binary) -> str:
        a, b = self(node.a), self(node.b) if node.op != "COLLATE" else ""
        match node.op:
            case "/":
                # Between integers it drops the fraction.
                whole = {"tinyint", "smallint", "int", "bigint"}
                return f"({a} div {b})" if self.kind(node.a) in whole and self.kind(node.b) in whole else f"({a} / {b})"
            case "~":
                return f"({a} RLIKE {b})"
            case "!~":
                return f"(NOT {a} RLIKE {b})"
            case "@>":
                return f"forall({b}, y -> array_contains({a}, y))"
            case "->" | "->>":
                return f"get_json_object({a}, concat('$.', {b}))"
            case "COLLATE":
                name = node.b.parts[-1]
                return f"({a} COLLATE {'UTF8_BINARY' if name.lower() in ('c', 'posix', 'ucs_basic') else name})"
        return f"({a} {node.op} {b})"

    def call(self, node: Call) -> str:
        name = FUNCTIONS.get(node.name, node.name)
        args = list(map(self, node.args))
        if node.name == "array_length":
            return f"nullif(size({args[0]}), 0)"
        if node.name == "position":
            return f"instr({args[1]}, {args[0]})"
        if node.name == "trunc" and len(args) == 1:
            return f"(CASE WHEN {args[0]} < 0 THEN ceil({args[0]}) ELSE floor({args[0]}) END)"
        if node.name == "jsonb_extract_path_text":
            return f"get_json_object({args[0]}, concat_ws('.', '$', {', '.join(args[1:])}))"
        return f"{name}({'DISTINCT ' * node.distinct}{', '.join(args)})"

    def sort(self, key: SortKey) -> str:
        return f"{self(key.expr)} {'DESC' if key.descending else 'ASC'} NULLS {'FIRST' if key.nulls_first else 'LAST'}"

    def order(self, keys: tuple[SortKey, ...]) -> str:
        return ", ".join(map(self.sort, keys))
