"""Per-row helpers over Python source, built on the standard library's ``ast``.

Scripts are only parsed, never run.
"""

import ast

from .constants import texts
from .paths import resolve_one

_LIMITS = (ValueError, RecursionError, MemoryError)


def parse(code: str):
    """``(tree, None)``, or ``(None, error)``.

    Besides syntax errors the parser may run out of stack or memory on hostile
    input; a row that cannot be parsed must not fail its task.
    """
    try:
        return ast.parse(code), None
    except (SyntaxError, *_LIMITS) as error:
        return None, error


def parquet_calls(tree):
    """Every ``<object>.parquet(...)`` call, outer before inner, left to right."""
    pending = [tree]
    while pending:
        node = pending.pop()
        if (
            isinstance(node, ast.Call)
            and isinstance(node.func, ast.Attribute)
            and node.func.attr == "parquet"
        ):
            yield node
        pending.extend(reversed(list(ast.iter_child_nodes(node))))


def path_argument(call):
    """The expression that names the path: first argument, else ``path=``."""
    if call.args:
        return call.args[0]
    return next((k.value for k in call.keywords if k.arg == "path"), None)


def inferred_paths(tree) -> dict:
    """The paths of the calls whose argument can have one text only, by call."""
    wanted = {call: path_argument(call) for call in parquet_calls(tree)}
    return texts(tree, {call: node for call, node in wanted.items() if node is not None})


def path_literal(call):
    """The string constant that names the path: first argument, else ``path=``."""

    def is_text(node):
        return isinstance(node, ast.Constant) and isinstance(node.value, str)

    if call.args and is_text(call.args[0]):
        return call.args[0]
    named = (k.value for k in call.keywords if k.arg == "path" and is_text(k.value))
    return next(named, None)


def direction(call) -> str:
    """``read`` or ``write``, whichever is nearest in the chain before the call."""
    node = call.func.value
    while True:
        name = None
        if isinstance(node, ast.Attribute):
            name, node = node.attr, node.value
        elif isinstance(node, ast.Call):
            node = node.func
        elif isinstance(node, ast.Subscript):
            node = node.value
        elif isinstance(node, ast.Name):
            name, node = node.id, None
        else:
            node = None
        if name in ("read", "write"):
            return name
        if node is None:
            return "unknown"


def rewrite(code: str, tree, error, base: str):
    """``(new code, None)`` with relative Parquet paths put under ``base``, from what
    ``parse`` made of ``code``. The paths of ``tree`` are changed.

    Code with a syntax error passes through unchanged, as ``(code, None)``, so
    that running it shows the error. Any other failure is returned as text.
    """
    if isinstance(error, SyntaxError):
        return code, None
    if error:
        return code, f"{type(error).__name__}: {error}"
    for call in parquet_calls(tree):
        literal = path_literal(call)
        if literal is not None:
            literal.value = resolve_one(literal.value, base)
    try:
        return ast.unparse(tree), None
    except _LIMITS as error:
        return code, f"{type(error).__name__}: {error}"
