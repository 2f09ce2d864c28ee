"""Row templates, compiled to expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F, types as T

from . import scalar

#: What a field that is missing or NULL prints.
MISSING = "<no value>"


class TemplateError(ValueError):
    """The text is no template."""


@dataclass
class _If:
    test: list
    then: list = field(default_factory=list)
    otherwise: list = field(default_factory=list)
    binds: bool = False  # ``with``: the dot becomes the tested value


_TOKEN = re.compile(r'\s*(\||:=|=|\$\w*|\.[A-Za-z_]\w*|\.|"(?:[^"\\]|\\.)*"|`[^`]*`|-?\d+(?:\.\d+)?|[A-Za-z_]\w*|\(|\))')


def _tokens(action: str) -> list[str]:
    found, i = [], 0
    action = action.strip()
    while i < len(action):
        m = _TOKEN.match(action, i)
        if not m:
            raise TemplateError(f"unexpected text in action: {action[i:]!r}")
        found.append(m[1])
        i = m.end()
    return found


def _parse(template: str) -> list:
    """Nested lists of text, pipelines (lists of tokens) and conditions."""
    top: list = []
    stack: list[tuple[list, _If | None]] = [(top, None)]
    i = 0
    while i < len(template):
        at = template.find("{{", i)
        if at < 0:
            stack[-1][0].append(template[i:])
            break
        text = template[i:at]
        end = template.find("}}", at)
        if end < 0:
            raise TemplateError("unclosed action")
        action = template[at + 2 : end]
        if action.startswith("- "):
            text, action = text.rstrip(), action[2:]
        i = end + 2
        if action.endswith(" -"):
            action = action[:-2]
            i += len(template[i:]) - len(template[i:].lstrip())
        if text:
            stack[-1][0].append(text)
        if action.strip().startswith("/*"):
            continue
        tokens = _tokens(action)
        if not tokens:
            raise TemplateError("missing value for command")
        if tokens[0] == "range":
            raise TemplateError("range can't iterate over a value of a row")
        if tokens[0] in ("if", "with"):
            node = _If(tokens[1:], binds=tokens[0] == "with")
            stack[-1][0].append(node)
            stack.append((node.then, node))
        elif tokens[0] == "else":
            node = stack[-1][1]
            if node is None:
                raise TemplateError("unexpected else")
            if tokens[1:2] == ["if"]:
                inner = _If(tokens[2:])
                node.otherwise.append(inner)
                stack[-1] = (inner.then, inner)
            else:
                stack[-1] = (node.otherwise, node)
        elif tokens[0] == "end":
            if len(stack) == 1:
                raise TemplateError("unexpected end")
            stack.pop()
        else:
            stack[-1][0].append(tokens)
    if len(stack) > 1:
        raise TemplateError("unexpected end of template: missing end")
    return top


@dataclass(frozen=True)
class _Value:
    column: Column
    kind: T.DataType | None  # None: text already


def _printed(value: _Value) -> Column:
    if value.kind is None or isinstance(value.kind, T.StringType):
        text = value.column
    elif isinstance(value.kind, (T.DoubleType, T.FloatType)):
        text = scalar.float_text(value.column.cast("double"))
    elif isinstance(value.kind, T.StructType):  # a cell of the change log
        c = value.column
        text = F.coalesce(c["string_value"], c["int_value"].cast("string"), scalar.float_text(c["float_value"]), c["bool_value"].cast("string"), c["timestamp_value"])
    elif isinstance(value.kind, T.TimestampType):
        text = F.date_format(value.column, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    else:
        text = value.column.cast("string")
    return F.coalesce(text, F.lit(MISSING))


def _true(value: _Value) -> Column:
    c = value.column
    if isinstance(value.kind, T.BooleanType):
        test = c
    elif value.kind is None or isinstance(value.kind, T.StringType):
        test = c != ""
    elif isinstance(value.kind, T.StructType):
        test = F.coalesce(c["string_value"] != "", c["int_value"] != 0, c["float_value"] != 0, c["bool_value"], c["timestamp_value"] != "")
    elif isinstance(value.kind, T.NumericType):
        test = c != 0
    else:
        test = c.isNotNull()
    return F.coalesce(test, F.lit(False))


def _text(token: str) -> str:
    if token.startswith("`"):
        return token[1:-1]
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), token[1:-1])


@dataclass(frozen=True)
class _Scope:
    """What names mean at a place of the template: the row's fields, the dot (None: the row), and variables."""

    fields: Mapping[str, tuple[Column, T.DataType]]
    dot: _Value | None
    variables: dict[str, _Value]


def _tree(tokens: list[str]) -> list:
    """The tokens with parts in parentheses as lists of their own."""
    stack: list[list] = [[]]
    for token in tokens:
        if token == "(":
            stack.append([])
        elif token == ")":
            if len(stack) == 1:
                raise TemplateError("unexpected right paren")
            inner = stack.pop()
            stack[-1].append(inner)
        else:
            stack[-1].append(token)
    if len(stack) > 1:
        raise TemplateError("unclosed left paren")
    return stack[0]


def _operand(token, scope: _Scope) -> _Value:
    if isinstance(token, list):
        return _pipeline(token, scope)
    if token == "." and scope.dot is not None:
        return scope.dot
    if token.startswith("$") and len(token) > 1:
        if token not in scope.variables:
            raise TemplateError(f"undefined variable {token!r}")
        return scope.variables[token]
    if token.startswith(".") and len(token) > 1:
        if scope.dot is not None:
            raise TemplateError(f"can't evaluate field {token[1:]} of a value")
        if token[1:] in scope.fields:
            return _Value(*scope.fields[token[1:]])
        return _Value(F.lit(None).cast("string"), None)
    if token[0] in "\"`":
        return _Value(F.lit(_text(token)), None)
    if token in ("true", "false"):
        return _Value(F.lit(token == "true"), T.BooleanType())
    if re.fullmatch(r"-?\d+", token):
        return _Value(F.lit(int(token)), T.LongType())
    if re.fullmatch(r"-?\d+\.\d+", token):
        return _Value(F.lit(float(token)), T.DoubleType())
    raise TemplateError(f"function {token!r} not defined")


def _kind_of(value: _Value) -> str | None:
    """text, number or bool; None for a cell, whose kind is the row's."""
    if value.kind is None or isinstance(value.kind, T.StringType):
        return "text"
    if isinstance(value.kind, T.BooleanType):
        return "bool"
    if isinstance(value.kind, T.NumericType):
        return "number"
    return None


def _compared(name: str, left: _Value, right: _Value) -> Column:
    """A comparison of two values of one kind; cells compare by what they print.  A missing value is equal to nothing."""
    kinds = {_kind_of(left), _kind_of(right)}
    if len(kinds - {None}) > 1:
        raise TemplateError("incompatible types for comparison")
    if kinds == {"bool"} and name not in ("eq", "ne"):
        raise TemplateError("invalid type for comparison")
    a, b = (left.column, right.column) if None not in kinds else (_printed(left), _printed(right))
    made = {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[name]
    return F.coalesce(made, F.lit(name == "ne"))


_VERB = re.compile(r"%([-+ 0#]*\d*(?:\.\d+)?)([a-zA-Z%])")


def _formatted(pattern: str, values: list[_Value]) -> Column:
    """printf with %s, %v, %q, %d, %x, %t, %f and %%."""
    parts, at, rest = [], 0, list(values)
    for m in _VERB.finditer(pattern):
        parts.append(F.lit(pattern[at : m.start()]))
        at = m.end()
        if m[2] == "%":
            parts.append(F.lit("%"))
            continue
        if not rest:
            raise TemplateError(f"missing value for %{m[2]}")
        value = rest.pop(0)
        kind = _kind_of(value)
        if m[2] in ("s", "v", "t"):
            made = _printed(value)
            parts.append(F.format_string(f"%{m[1]}s", made) if m[1] else made)
        elif m[2] == "q":
            parts.append(F.concat(F.lit('"'), F.replace(F.replace(_printed(value), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
        elif m[2] in "dx" and kind == "number" and not isinstance(value.kind, (T.DoubleType, T.FloatType)):
            parts.append(F.coalesce(F.format_string(f"%{m[1]}{m[2]}", value.column.cast("bigint")), F.lit(f"%!{m[2]}(<nil>)")))
        elif m[2] == "f" and kind == "number":
            parts.append(F.coalesce(F.format_string(f"%{m[1]}f", value.column.cast("double")), F.lit("%!f(<nil>)")))
        else:
            raise TemplateError(f"%{m[2]} does not fit the value")
    if rest:
        raise TemplateError("more values than verbs")
    return F.concat(*parts, F.lit(pattern[at:])) if parts else F.lit(pattern)


# Least and most number of arguments of each function.
_FUNCTIONS = {
    "lower": (1, 1), "upper": (1, 1), "slugify": (1, 1), "before": (2, 2), "after": (2, 2), "eq": (2, 99), "ne": (2, 2), "lt": (2, 2), "le": (2, 2), "gt": (2, 2), "ge": (2, 2),
    "and": (1, 99), "or": (1, 99), "not": (1, 1), "len": (1, 1), "print": (0, 99), "println": (0, 99), "printf": (1, 99),
}


def _called(name: str, given: list, values: list[_Value]) -> _Value:
    least, most = _FUNCTIONS[name]
    if not least <= len(values) <= most:
        raise TemplateError(f"wrong number of arguments for {name}")
    yes = T.BooleanType()
    if name in ("lower", "upper", "slugify"):
        return _Value({"lower": F.lower, "upper": F.upper, "slugify": scalar.slugify}[name](_printed(values[0])), None)
    if name in ("before", "after"):
        if not isinstance(given[0], str) or given[0][:1] not in "\"`":
            raise TemplateError(f"{name} takes a quoted separator")
        return _Value((scalar.before if name == "before" else scalar.after)(_printed(values[1]), _text(given[0])), None)
    if name == "eq":
        found = F.lit(False)
        for other in values[1:]:
            found = found | _compared("eq", values[0], other)
        return _Value(found, yes)
    if name in ("ne", "lt", "le", "gt", "ge"):
        return _Value(_compared(name, *values), yes)
    if name == "not":
        return _Value(~_true(values[0]), yes)
    if name in ("and", "or"):
        # The first value that decides, else the last; of one kind they keep it, else they are printed.
        kinds = {str(v.kind) for v in values}
        shown = [v.column if len(kinds) == 1 else _printed(v) for v in values]
        made = shown[-1]
        for value, column in list(zip(values, shown))[-2::-1]:
            made = F.when(_true(value) if name == "or" else ~_true(value), column).otherwise(made)
        return _Value(made, values[0].kind if len(kinds) == 1 else None)
    if name == "len":
        if _kind_of(values[0]) in ("number", "bool"):
            raise TemplateError("len of a value without length")
        return _Value(F.octet_length(_printed(values[0])).cast("bigint"), T.LongType())
    if name == "printf":
        if not isinstance(given[0], str) or given[0][:1] not in "\"`":
            raise TemplateError("printf takes a quoted format")
        return _Value(_formatted(_text(given[0]), values[1:]), None)
    # print puts blanks between values that are both no text, println between all.
    parts: list[Column] = []
    for i, value in enumerate(values):
        if i and (name == "println" or "text" not in (_kind_of(values[i - 1]), _kind_of(value))):
            parts.append(F.lit(" "))
        parts.append(_printed(value))
    return _Value(F.concat(F.lit(""), *parts, *([F.lit("\n")] if name == "println" else [])), None)


def _pipeline(tree: list, scope: _Scope) -> _Value:
    commands: list[list] = [[]]
    for token in tree:
        if token == "|":
            commands.append([])
        else:
            commands[-1].append(token)
    value: _Value | None = None
    for command in commands:
        if not command:
            raise TemplateError("missing value for command")
        name, *rest = command
        if isinstance(name, str) and name in _FUNCTIONS:
            values = [_operand(t, scope) for t in rest] + ([value] if value is not None else [])
            value = _called(name, rest, values)
        else:
            if rest or value is not None:
                raise TemplateError(f"{name!r} is no function")
            value = _operand(name, scope)
    return value


def _assigned(tokens: list[str]) -> tuple[str | None, list]:
    """The variable that an action sets, if it does, and its pipeline."""
    if len(tokens) > 2 and tokens[0].startswith("$") and tokens[1] in (":=", "="):
        return tokens[0], _tree(tokens[2:])
    return None, _tree(tokens)


def fields_of(template: str) -> set[str]:
    """Names of the fields that a template reads."""
    found: set[str] = set()

    def walk(nodes: list) -> None:
        for n in nodes:
            if isinstance(n, _If):
                found.update(t[1:] for t in n.test if t.startswith(".") and len(t) > 1)
                walk(n.then)
                walk(n.otherwise)
            elif isinstance(n, list):
                found.update(t[1:] for t in n if t.startswith(".") and len(t) > 1)

    walk(_parse(template))
    return found


def compile_template(template: str, fields: Mapping[str, tuple[Column, T.DataType]]) -> Column:
    """The template as one expression over the row's fields; TemplateError if it is none."""

    def build(nodes: list, scope: _Scope) -> Column:
        # Variables set inside of a block end with it.
        here = _Scope(scope.fields, scope.dot, dict(scope.variables))
        parts = []
        for n in nodes:
            if isinstance(n, str):
                parts.append(F.lit(n))
                continue
            name, tree = _assigned(n.test if isinstance(n, _If) else n)
            value = _pipeline(tree, here)
            if isinstance(n, _If):
                inside = _Scope(here.fields, value if n.binds else here.dot, here.variables | ({name: value} if name else {}))
                parts.append(F.when(_true(value), build(n.then, inside)).otherwise(build(n.otherwise, here)))
            elif name:
                here.variables[name] = value
            else:
                parts.append(_printed(value))
        return F.concat(*parts) if parts else F.lit("")

    return build(_parse(template), _Scope(fields, None, {}))
