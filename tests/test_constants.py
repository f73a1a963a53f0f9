"""Constant propagation against real runs: what is inferred is what the script passes."""

import ast
import itertools
import random

import pytest

from scriptflow.functions import pyscript


def inferred(code):
    tree = ast.parse(code)
    found = pyscript.inferred_paths(tree)
    return [found.get(call) for call in pyscript.parquet_calls(tree)]


@pytest.mark.parametrize(
    "code, want",
    [
        ("p = 'x'\nr.parquet(p)", "x"),
        ("p: str = 'x'\nr.parquet(path=p)", "x"),
        ("a = 'x'\nb = a + '/' + 'y'\nr.parquet(b)", "x/y"),
        ("a = 'x'\na += '1'\nr.parquet(a)", "x1"),
        ("d = 'x'\nn = 3\nr.parquet(f'{d}/part={n}')", "x/part=3"),
        ("d = 'x'\nr.parquet(f'{d!r}/{1 + 1}')", None),
        ("d = 'x'\nr.parquet(f'{d:>9}')", None),
        ("a, b = 'x', 'y'\na, b = b, a\nr.parquet(a + b)", "yx"),
        ("a = b = 'x'\nr.parquet(b)", "x"),
        ("p = 'x'\nif c:\n    p = 'y'\nr.parquet(p)", None),
        ("if c:\n    p = 'x'\nelse:\n    p = 'x'\nr.parquet(p)", "x"),
        ("if c:\n    p = 'x'\n    r.parquet(p)", "x"),
        ("p = 'x' if c else 'y'\nr.parquet(p)", None),
        ("for p in ['x']:\n    r.parquet(p)", None),
        ("p = 'x'\nfor k in z:\n    r.parquet(p)\n    p = 'y'", None),
        ("for k in z:\n    p = 'y'\n    r.parquet(p)", "y"),
        ("p = 'x'\nfor k in z:\n    q = 1\nr.parquet(p)", "x"),
        ("p = ''\nwhile c:\n    p += 'x'\nr.parquet(p)", None),
        ("p = 'x'\ntry:\n    p = 'y'\n    f()\nexcept E:\n    r.parquet(p)", None),
        ("try:\n    p = 'y'\n    r.parquet(p)\nfinally:\n    q = 1", "y"),
        ("try:\n    p = 'y'\nfinally:\n    r.parquet(p)", None),
        ("with f() as p:\n    r.parquet(p)", None),
        ("p = 'x'\nwith f():\n    p = 'y'\nr.parquet(p)", None),
        ("p = 'x'\ndef f():\n    r.parquet(p)\nf()", "x"),
        ("p = 'x'\ndef f():\n    r.parquet(p)\np = 'y'\nf()", None),
        ("p = 'x'\ndef f(p):\n    r.parquet(p)", None),
        ("p = 'x'\ndef f():\n    p = 'y'\n    r.parquet(p)", "y"),
        ("p = 'x'\ndef f():\n    r.parquet(p)\n    p = 'y'", None),
        ("p = 'x'\ndef f():\n    global p\n    p = 'y'\nf()\nr.parquet(p)", None),
        ("def f():\n    p = 'x'\n    def g():\n        r.parquet(p)\n    p = 'y'\n    g()", None),
        ("p = 'x'\ng = lambda: r.parquet(p)\np = 'y'\ng()", None),
        ("p = 'x'\ng = lambda: r.parquet(p)", "x"),
        ("p = 'x'\n[r.parquet(p) for k in z]", "x"),
        ("p = 'x'\n[r.parquet(p) for p in z]", None),
        ("class A:\n    p = 'x'\n    r.parquet(p)", "x"),
        ("p = 'x'\nexec(c)\nr.parquet(p)", None),
        ("p = 'x'\nfrom m import *\nr.parquet(p)", None),
        ("p = 'x'\nimport p\nr.parquet(p)", None),
        ("p = 'x'\ndel p\nr.parquet(p)", None),
        ("if (p := 'x'):\n    r.parquet(p)", None),
        ("p = 'x'\n(p := c)\nr.parquet(p)", None),
        ("p = 'x'\n[(p := k) for k in z]\nr.parquet(p)", None),
        ("match c:\n    case p:\n        r.parquet(p)", None),
        ("p = 1\nr.parquet(p)", None),
        ("r.parquet(*p)", None),
        ("r.parquet()", None),
        ("r.parquet('x')", "x"),
        ("a = 'x' * 9\nr.parquet(a)", None),
        ("\n".join(["a = 'xx'", *["a = a + a"] * 60, "r.parquet(a)"]), None),
        ("p = " + " + ".join(["'x'"] * 200) + "\nr.parquet(p)", "x" * 200),
    ],
)
def test_rules(code, want):
    assert inferred(code) == [want]


def test_too_deep_is_unknown():
    code = "p = 'x'\n" + "r.parquet(p)\n" + "if c:\n    pass\n" + "elif c:\n    pass\n" * 3000
    try:
        ast.parse(code)
    except (RecursionError, MemoryError):
        return
    assert inferred(code) in (["x"], [None])


def test_equals_runs():
    """Random scripts, run with every choice of their conditions: a path that is inferred
    is the only one that any run passes."""
    rng = random.Random(12)
    names = ["a", "b", "c"]

    def text():
        kind = rng.randrange(4)
        if kind == 0:
            return repr(rng.choice("xyz"))
        if kind == 1:
            return rng.choice(names)
        if kind == 2:
            return f"{rng.choice(names)} + {rng.choice('xy')!r}"
        return "f'{" + rng.choice(names) + "}-" + rng.choice("xy") + "'"

    def block(depth, pad):
        out = []
        for _ in range(rng.randrange(1, 4)):
            kind = rng.randrange(9 if depth else 4)
            if kind <= 1:
                out.append(f"{pad}{rng.choice(names)} = {text()}")
            elif kind == 2:
                out.append(f"{pad}r.parquet({text()})")
            elif kind == 3:
                out.append(f"{pad}{rng.choice(names)} += {rng.choice('xy')!r}")
            elif kind <= 5:
                out += [f"{pad}if go():", *block(depth - 1, pad + " "), f"{pad}else:", *block(depth - 1, pad + " ")]
            elif kind == 6:
                out += [f"{pad}for k in range(go() + 1):", *block(depth - 1, pad + " ")]
            elif kind == 7:
                out += [f"{pad}try:", *block(depth - 1, pad + " "), f"{pad} stop()", f"{pad}except KeyError:", *block(depth - 1, pad + " ")]
            else:
                name = f"f{rng.randrange(10**6)}"
                out += [f"{pad}def {name}():", *block(depth - 1, pad + " "), f"{pad}{name}()"]
        return out

    known = total = 0
    for _ in range(400):
        code = "\n".join(["a = 'p'", "b = 'q'", "c = 'r'", *block(2, "")])
        tree = ast.parse(code)
        found = pyscript.inferred_paths(tree)
        calls = list(pyscript.parquet_calls(tree))
        # Each call passes its number, so that runs can tell which one it was.
        for number, call in enumerate(calls):
            call.args.append(ast.Constant(number))
        program = compile(ast.fix_missing_locations(tree), "script", "exec")
        passed = {number: set() for number in range(len(calls))}

        class Reader:
            def parquet(self, path, number):
                passed[number].add(path)

        for bits in itertools.islice(itertools.product((0, 1), repeat=6), 64):
            choice = itertools.cycle(bits)

            def stop():
                if next(choice):
                    raise KeyError

            try:
                exec(program, {"r": Reader(), "go": lambda: next(choice), "stop": stop})
            except NameError:
                pass
        for number, call in enumerate(calls):
            total += 1
            if call in found:
                known += 1
                assert passed[number] <= {found[call]}, (code, number, passed[number], found[call])
    assert known > total / 4
