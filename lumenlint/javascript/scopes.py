"""Which names a file declares and which of these it reads.

Scopes are functions and blocks; `var` and functions rise as the language has it. A name in a type counts as a read, as
does one in JSX or in an export list. Writing alone is no read. Where it is unclear whether something is read, it counts
as read.
"""

from __future__ import annotations

from .parser import Node

FUNCTIONS = ("Function", "Arrow", "Method")
_BLOCKS = ("Block", "For", "ForIn", "Switch", "Catch", "Class", "TypeAlias", "Interface", "FunctionType", "Program", "Namespace", "Static")


class Declared:
    def __init__(self, name: str, what: str, node: Node, exported: bool = False, keep: bool = False, group=None):
        self.name, self.what, self.node, self.exported, self.keep, self.group, self.reads = name, what, node, exported, keep, group, 0


class Scope:
    def __init__(self, above: Scope | None, function: bool):
        self.above, self.function, self.names = above, function, {}

    def declare(self, found: Declared) -> None:
        self.names.setdefault(found.name, []).append(found)

    def read(self, name: str) -> None:
        scope: Scope | None = self
        while scope is not None:
            if name in scope.names:
                for d in scope.names[name]:
                    d.reads += 1
                return
            scope = scope.above


def targets(pattern: Node):
    """(name node, whether a rest next to it gives it a purpose) of a binding."""
    if pattern.kind == "Name":
        yield pattern, False
    else:
        with_rest = pattern.kind == "ObjectPattern" and any(i.rest for i in pattern.items)
        for item in pattern.items or []:
            for name, keep in targets(item.target):
                yield name, keep or with_rest and not item.rest


class Analysis:
    def __init__(self, tree: Node):
        self.found: list[Declared] = []
        self.reads: list[tuple[Scope, str]] = []
        self.module = any(n.kind in ("Import", "Export") for n in tree.body)
        top = Scope(None, True)
        self._enter(tree, top, None)
        for scope, name in self.reads:
            scope.read(name)
        self.top = top

    def _declare(self, scope: Scope, name: Node, what: str, **more) -> None:
        d = Declared(name.name, what, name, **more)
        self.found.append(d)
        scope.declare(d)

    def _of_function(self, scope: Scope) -> Scope:
        while not scope.function:
            scope = scope.above
        return scope

    def _pattern(self, pattern: Node, scope: Scope) -> None:
        """Reads inside of a binding: defaults and computed keys."""
        for item in pattern.items or []:
            if item.default is not None:
                self._enter(item.default, scope, item)
            if item.key is not None and item.key.kind == "Computed":
                self._enter(item.key, scope, item)
            self._pattern(item.target, scope)

    def _enter(self, node: Node, scope: Scope, parent: Node | None, exported: bool = False, ambient: bool = False) -> None:
        kind = node.kind
        if kind == "Name" or kind == "TypeName":
            self.reads.append((scope, node.name))
            return
        if kind == "Import":
            for n in node.names:
                self._declare(scope, n, "import", group=node)
            return
        if kind == "Export":
            if node.declaration is not None:
                self._enter(node.declaration, scope, node, exported=True, ambient=ambient)
            for n in node.names or []:
                if node.source is None:
                    self.reads.append((scope, n.imported))
            return
        if kind == "Variables":
            home = self._of_function(scope) if node.how == "var" else scope
            for v in node.list:
                for name, keep in targets(v.target):
                    in_loop = parent is not None and parent.kind == "ForIn"
                    self._declare(home, name, "variable", exported=exported or ambient, keep=keep or in_loop, group=v)
                self._pattern(v.target, scope)
                for part in (v.hint, v.init):
                    if part is not None:
                        self._enter(part, scope, v)
            return
        if kind in ("TypeAlias", "Interface", "Enum"):
            self._declare(scope, node.id, "type" if kind != "Enum" else "variable", exported=exported or ambient)
        if kind == "Namespace" and node.id is not None:
            self._declare(scope, node.id, "variable", exported=True)
        if kind == "Function" and node.declared and node.id is not None:
            self._declare(scope if scope.function else scope, node.id, "function", exported=exported or ambient or node.body is None)
        if kind == "Class" and node.declared and node.id is not None:
            self._declare(scope, node.id, "class", exported=exported or ambient)
        if kind == "Declare" or kind == "Namespace":
            ambient = True
        for mark in node.decorators or []:
            self._enter(mark, scope, node)
        if kind in FUNCTIONS or kind == "FunctionType":
            inner = Scope(scope, True)
            if kind == "Function" and not node.declared and node.id is not None:
                inner.declare(Declared(node.id.name, "own", node.id))
            if kind == "Method":
                self._enter(node.key, scope, node)
            for p in node.generics or []:
                self._enter(p, inner, node)
            signature = kind == "FunctionType" or node.body is None or kind == "Method" and "set" in (node.how or ())
            for i, p in enumerate(node.params):
                for name, keep in targets(p.target):
                    self._declare(inner, name, "parameter", keep=keep or signature or bool(p.access) or bool(p.decorators) or name.name == "this", group=(node, i))
                self._pattern(p.target, inner)
                for part in (p.hint, p.default, *(p.decorators or [])):
                    if part is not None:
                        self._enter(part, inner, p)
            if node.returns is not None:
                self._enter(node.returns, inner, node)
            if isinstance(node.body, Node):
                if node.body.kind == "Block":
                    for s in node.body.body:
                        self._enter(s, inner, node.body)
                else:
                    self._enter(node.body, inner, node)
            return
        if kind == "TypeParameter":
            scope.declare(Declared(node.id.name, "own", node.id))
            for p in node.parts:
                self._enter(p, scope, node)
            return
        inner = Scope(scope, kind in ("Program", "Namespace", "Static")) if kind in _BLOCKS and parent is not None else scope
        if kind == "Class" and node.id is not None and not node.declared:
            inner.declare(Declared(node.id.name, "own", node.id))
        if kind == "Type" and node.infer:
            self._of_function(scope).declare(Declared(node.infer, "own", node))
        if kind == "Catch" and node.param is not None:
            for name, _ in targets(node.param):
                inner.declare(Declared(name.name, "own", name))
        if kind == "Jsx":
            tag = node.tag.split(".")[0].split(":")[0]
            if tag[:1].isupper() or "." in node.tag:
                self.reads.append((scope, tag))
            self.reads += [(scope, "React"), (scope, "h")]
        if kind == "Assign":
            if node.left.kind in ("Object", "Array"):
                self._writes(node.left, scope)
            elif node.left.kind != "Name" or parent is not None and parent.kind != "Expression":
                self._enter(node.left, inner, node)
            self._enter(node.right, inner, node)
            return
        if kind == "Update" and node.argument.kind == "Name" and parent is not None and parent.kind == "Expression":
            return
        for child in node.children():
            if child is node.id or child is node.param and kind == "Catch":
                continue
            if kind in ("Property", "Field") and child is node.key and child.kind == "Key":
                continue
            self._enter(child, inner, node, ambient=ambient)

    def _writes(self, node: Node, scope: Scope) -> None:
        """An assignment to a pattern: names in it are written, all else is read."""
        for item in node.items:
            value = item.value if item.kind == "Property" else item.argument if item.kind == "Spread" else item
            if item.kind == "Property" and item.key.kind == "Computed":
                self._enter(item.key, scope, item)
            if value.kind == "Assign":
                self._enter(value.right, scope, value)
                value = value.left
            if value.kind in ("Object", "Array"):
                self._writes(value, scope)
            elif value.kind != "Name":
                self._enter(value, scope, item)

    def unused(self) -> list[Declared]:
        """Declarations without a read. What a script declares at its top may be read elsewhere."""
        at_top = {id(d) for ds in self.top.names.values() for d in ds}
        out = []
        for d in self.found:
            if d.reads or d.exported or d.keep or id(d) in at_top and not self.module and d.what != "import":
                continue
            if d.what in ("variable", "parameter") and d.name.startswith("_"):
                continue
            if d.what == "parameter":
                function, place = d.group
                later = {id(n) for p in function.params[place + 1 :] for n, _ in targets(p.target)}
                if any(x.reads for x in self.found if id(x.node) in later):
                    continue
            out.append(d)
        return out
