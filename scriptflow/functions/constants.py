"""Which constant text an argument has: propagation through names, ``+`` and f-strings.

A walk over the statements in order keeps for every name the one constant it must have, if
it has. Where branches meet, a name keeps its value only if all give the same; a loop first
forgets what it assigns; a handler forgets what its ``try`` assigns. Inside a function, a
name of the module has a value only if it is bound once in the whole module. Whatever is
not understood is unknown, so a value that is given is the only one that can be there.

Scripts are only parsed, never run.
"""

import ast

#: Longer texts are unknown: repeated doubling would otherwise grow without bound.
MAX_TEXT = 4096

_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef)
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
#: Calls through which names can change unseen.
_OPAQUE = {"exec", "eval", "globals", "locals", "vars"}


class _Unknown:
    def __repr__(self):
        return "?"


UNKNOWN = _Unknown()


def _bound(node, into_scopes=False) -> set[str]:
    """The names that a statement or expression binds in its own scope."""
    out, pending = set(), [node]
    while pending:
        node = pending.pop()
        if isinstance(node, ast.Name) and isinstance(node.ctx, (ast.Store, ast.Del)):
            out.add(node.id)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.add(node.name)
        elif isinstance(node, ast.ExceptHandler) and node.name:
            out.add(node.name)
        elif isinstance(node, ast.alias):
            out.add((node.asname or node.name).split(".")[0])
        elif isinstance(node, (ast.MatchAs, ast.MatchStar)) and node.name:
            out.add(node.name)
        elif isinstance(node, ast.MatchMapping) and node.rest:
            out.add(node.rest)
        if into_scopes or not isinstance(node, _SCOPES):
            pending.extend(ast.iter_child_nodes(node))
    return out


def _sites(tree) -> dict[str, int]:
    """How often each name is bound in the module itself."""
    counts: dict[str, int] = {}
    pending = list(ast.iter_child_nodes(tree))
    while pending:
        node = pending.pop()
        names = _bound(node) if not list(ast.iter_child_nodes(node)) else set()
        if isinstance(node, (*_SCOPES, ast.ExceptHandler, ast.alias, ast.MatchAs, ast.MatchStar)):
            names = {getattr(node, "name", None)} if not isinstance(node, ast.alias) else _bound(node)
        elif isinstance(node, ast.Name):
            names = _bound(node)
        elif isinstance(node, ast.AugAssign) and isinstance(node.target, ast.Name):
            names = {node.target.id}  # a second value, besides the target itself
        for name in names - {None}:
            counts[name] = counts.get(name, 0) + 1
        if not isinstance(node, _SCOPES):
            pending.extend(ast.iter_child_nodes(node))
    return counts


class Constants:
    """The constant texts of some expressions of a module.

    ``wanted`` maps calls to the expression whose value is asked for; ``values`` has, after
    the walk, what is known of them by call.
    """

    def __init__(self, tree, wanted: dict):
        self.wanted, self.values = wanted, {}
        self.env: dict[str, object] = {}
        nodes = list(ast.walk(tree))
        self.opaque = any(
            (isinstance(n, ast.Name) and n.id in _OPAQUE)
            or (isinstance(n, ast.alias) and n.name == "*")
            for n in nodes
        )
        self.shared = {
            name for n in nodes if isinstance(n, (ast.Global, ast.Nonlocal)) for name in n.names
        }
        self.sites = _sites(tree)
        self.once: dict[str, object] = {}
        self.inside: list = []
        self.locals: set[str] = set()
        if self.opaque:
            return
        self._block(tree.body)
        # Functions run later: of the module's names they see those that never change.
        once = {k: v for k, v in self.once.items() if self.sites.get(k) == 1}
        while self.inside:
            node, outer = self.inside.pop()
            self._scope(node, {**once, **{k: UNKNOWN for k in outer}}, outer)

    # Values

    def value(self, node):
        """The constant that an expression has, or ``UNKNOWN``."""
        found = self._value(node)
        return UNKNOWN if isinstance(found, str) and len(found) > MAX_TEXT else found

    def _value(self, node):
        if isinstance(node, ast.Constant):
            return node.value if isinstance(node.value, (str, int, bool)) else UNKNOWN
        if isinstance(node, ast.Name):
            return self.env.get(node.id, UNKNOWN)
        if isinstance(node, ast.NamedExpr):
            return self.value(node.value)
        if isinstance(node, ast.IfExp):
            one, other = self.value(node.body), self.value(node.orelse)
            return one if _same(one, other) else UNKNOWN
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            left, right = self.value(node.left), self.value(node.right)
            return left + right if isinstance(left, str) and isinstance(right, str) else UNKNOWN
        if isinstance(node, ast.JoinedStr):
            parts = [self._formatted(part) for part in node.values]
            return "".join(parts) if all(isinstance(p, str) for p in parts) else UNKNOWN
        return UNKNOWN

    def _formatted(self, part):
        if not isinstance(part, ast.FormattedValue):
            return self.value(part)
        value = self.value(part.value)
        # A format may ask for any width; only plain ones are understood.
        if value is UNKNOWN or part.format_spec is not None:
            return UNKNOWN
        return {115: str, 114: repr, 97: ascii}.get(part.conversion, format)(value)

    # Statements

    def _expression(self, node):
        """Note the wanted values in an expression, then what it binds."""
        pending = [node]
        while pending:
            node = pending.pop()
            if isinstance(node, (ast.Lambda, *_COMPREHENSIONS)):
                self.inside.append((node, self._local(node)))
                for name in _bound(node, into_scopes=True) - self._targets(node):
                    self.env[name] = UNKNOWN  # bound by := inside
                continue
            if node in self.wanted:
                value = self.value(self.wanted[node])
                known = self.values.get(node, value)
                self.values[node] = value if _same(value, known) else UNKNOWN
            if isinstance(node, ast.NamedExpr):
                self._bind(node.target, UNKNOWN)
            pending.extend(ast.iter_child_nodes(node))

    def _targets(self, node) -> set[str]:
        if isinstance(node, ast.Lambda):
            return set()
        return set().union(*(_bound(g.target) for g in node.generators))

    def _local(self, node) -> set[str]:
        """Names that are not the module's inside a function, lambda or comprehension."""
        out = set(self.locals)
        if hasattr(node, "args"):
            out |= {a.arg for a in ast.walk(node.args) if isinstance(a, ast.arg)}
        for part in ast.iter_child_nodes(node):
            out |= _bound(part)
        return out

    def _bind(self, target, value):
        if isinstance(target, ast.Name):
            value = UNKNOWN if target.id in self.shared else value
            self.env[target.id] = value
            self.once[target.id] = value
        else:
            for name in _bound(target):
                self._bind(ast.Name(name, ast.Store()), UNKNOWN)

    def _forget(self, names):
        for name in names:
            self.env[name] = UNKNOWN

    def _branches(self, *blocks):
        """Run blocks from the same start and keep what all agree on."""
        start, ends = dict(self.env), []
        for block in blocks:
            self.env = dict(start)
            block()
            ends.append(self.env)
        names = set().union(*ends)
        self.env = {
            k: ends[0].get(k, UNKNOWN)
            if all(_same(ends[0].get(k, UNKNOWN), e.get(k, UNKNOWN)) for e in ends)
            else UNKNOWN
            for k in names
        }

    def _block(self, statements):
        for statement in statements:
            self._statement(statement)

    def _statement(self, node):
        names = _bound(node)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            for part in (*node.decorator_list, *getattr(node, "bases", ())):
                self._expression(part)
            if not isinstance(node, ast.ClassDef):
                for default in (*node.args.defaults, *filter(None, node.args.kw_defaults)):
                    self._expression(default)
            self.inside.append((node, self._local(node)))
            self._bind(ast.Name(node.name, ast.Store()), UNKNOWN)
        elif isinstance(node, ast.Assign):
            self._expression(node.value)
            value = self.value(node.value)
            for target in node.targets:
                if (
                    isinstance(target, (ast.Tuple, ast.List))
                    and isinstance(node.value, (ast.Tuple, ast.List))
                    and len(target.elts) == len(node.value.elts)
                    and not any(isinstance(e, ast.Starred) for e in (*target.elts, *node.value.elts))
                ):
                    values = [self.value(e) for e in node.value.elts]
                    for one, its in zip(target.elts, values):
                        self._bind(one, its)
                else:
                    self._expression(target)
                    self._bind(target, value)
        elif isinstance(node, ast.AnnAssign):
            if node.value is not None:
                self._expression(node.value)
                self._bind(node.target, self.value(node.value))
        elif isinstance(node, ast.AugAssign):
            self._expression(node.value)
            if isinstance(node.target, ast.Name):
                old = ast.Name(node.target.id, ast.Load())
                self._bind(node.target, self.value(ast.BinOp(old, node.op, node.value)))
        elif isinstance(node, ast.If):
            self._expression(node.test)
            self._branches(lambda: self._block(node.body), lambda: self._block(node.orelse))
        elif isinstance(node, (ast.For, ast.AsyncFor, ast.While)):
            if not isinstance(node, ast.While):
                self._expression(node.iter)
            self._forget(names)
            if isinstance(node, ast.While):
                self._expression(node.test)
            self._branches(lambda: self._block(node.body), lambda: None)
            self._branches(lambda: self._block(node.orelse), lambda: None)
        elif isinstance(node, (ast.Try, ast.TryStar)):
            assigned = set().union(*map(_bound, node.body)) if node.body else set()

            def handled(handler):
                self._forget(assigned)
                if handler.type is not None:
                    self._expression(handler.type)
                self._forget(_bound(handler))
                self._block(handler.body)

            self._branches(
                lambda: self._block([*node.body, *node.orelse]),
                *[lambda h=h: handled(h) for h in node.handlers],
            )
            kept = dict(self.env)
            if node.finalbody:
                # It also runs after an error somewhere before.
                self._forget(names - set().union(*map(_bound, node.finalbody)))
                self._block(node.finalbody)
                final = set().union(*map(_bound, node.finalbody))
                self.env = {**kept, **{k: self.env.get(k, UNKNOWN) for k in final}}
        elif isinstance(node, (ast.With, ast.AsyncWith)):
            for item in node.items:
                self._expression(item.context_expr)
                if item.optional_vars is not None:
                    self._bind(item.optional_vars, UNKNOWN)
            # A context may swallow an error.
            self._branches(lambda: self._block(node.body), lambda: None)
        elif isinstance(node, ast.Match):
            self._expression(node.subject)

            def case(one):
                self._forget(_bound(one.pattern))
                if one.guard is not None:
                    self._expression(one.guard)
                self._block(one.body)

            self._branches(*[lambda c=c: case(c) for c in node.cases], lambda: None)
        else:
            for part in ast.iter_child_nodes(node):
                self._expression(part)
            for name in names:
                self._bind(ast.Name(name, ast.Store()), UNKNOWN)

    def _scope(self, node, env, local):
        """The inside of a function, class, lambda or comprehension."""
        once, self.once = self.once, {}
        self.env, self.locals = dict(env), local
        if isinstance(node, (ast.Lambda, *_COMPREHENSIONS)):
            for part in ast.iter_child_nodes(node):
                self._expression(part)
        else:
            self._block(node.body)
        self.once, self.locals = once, set()


def _same(one, other) -> bool:
    return one is other or (
        one is not UNKNOWN and other is not UNKNOWN and type(one) is type(other) and one == other
    )


def texts(tree, wanted: dict) -> dict:
    """The constant text of the wanted expressions by call, where there is only one."""
    try:
        values = Constants(tree, wanted).values
    except RecursionError:
        return {}
    return {call: v for call, v in values.items() if isinstance(v, str)}
