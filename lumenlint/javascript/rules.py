"""Rules on one file's tree, the file's functions, and what it imports and exports.

`facts` returns plain rows, so a partition of files is read once and every relation comes out of that one pass.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from .flows import flows
from .parser import Node, ParseError, parse
from .scopes import FUNCTIONS, Analysis, targets

LIMITS = {"COMPLEX001": 10, "COMPLEX002": 15, "COMPLEX003": 100, "COMPLEX004": 5, "COMPLEX005": 4}
#: Names of functions and packages that the security rules are about.
COMMANDS = {"exec", "execSync"}
SPAWNS = {"execFile", "execFileSync", "spawn", "spawnSync"}
QUERIES = {"execute", "executeRawUnsafe", "query", "queryRawUnsafe", "raw", "$executeRawUnsafe", "$queryRawUnsafe"}
FILES = {"access", "accessSync", "appendFile", "appendFileSync", "createReadStream", "createWriteStream", "open", "openSync", "readFile", "readFileSync", "stat", "statSync", "unlink", "unlinkSync", "writeFile", "writeFileSync"}
WEAK_HASHES = {"des", "md5", "rc4", "sha1"}
COMMAND_LINE = {"cac", "clipanion", "commander", "meow", "sade", "yargs"}
MARKER = re.compile(r"\b(FIXME|HACK|TODO|XXX)\b")
SQL_VERB = re.compile(r"(?i)\b(select|insert|update|delete|drop|alter)\b")
REQUEST_PART = re.compile(r"\.(params|query|body)\b")
SANITISED = re.compile(r"(?i)sanitize|basename|escape|whitelist|allowlist")
_EXITS = ("Return", "Throw", "Break", "Continue")
_LOOPS = ("For", "ForIn", "While", "DoWhile")


def plain(node: Node | None) -> Node | None:
    """Without parentheses, casts and assertions."""
    while node is not None and node.kind in ("Paren", "As", "NonNull"):
        node = node.expression
    return node


def callee_name(node: Node) -> str:
    c = plain(node.callee)
    return c.name if c.kind == "Name" else c.property if c.kind == "Member" else ""


def dynamic(node: Node | None) -> bool:
    """Text put together at run time."""
    node = plain(node)
    return node is not None and (node.kind == "Template" and bool(node.parts) or node.kind == "Binary" and node.sign == "+" and not (literal(node.left) and literal(node.right)))


def literal(node: Node | None) -> bool:
    node = plain(node)
    return node is not None and (node.kind in ("String", "Number", "Boolean", "Null") or node.kind == "Template" and not node.parts or node.kind == "Binary" and node.sign == "+" and literal(node.left) and literal(node.right))


class File:
    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        self.tree, self.comments, self.tokens = parse(path, text)
        self.starts = [0] + [m.end() for m in re.finditer(r"\r\n|\r|\n", text)]
        self.parent: dict[int, Node] = {}
        self.nodes = list(self.tree.walk())
        for n in self.nodes:
            for c in n.children():
                self.parent[id(c)] = n
        self.typed = path.lower().endswith((".ts", ".tsx"))
        self.imported: dict[str, tuple[str, str]] = {}  # local name: (source, imported name)
        self.findings: list[tuple] = []
        self._imports()

    def place(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.starts, at)
        return line, at - self.starts[line - 1] + 1

    def source(self, node: Node) -> str:
        return self.text[node.start : node.end]

    def add(self, rule: str, severity: str, confidence: str, node: Node, evidence: str | None = None) -> None:
        line, col = self.place(node.start)
        self.findings.append((rule, severity, confidence, line, col, (self.source(node) if evidence is None else evidence)[:160]))

    def up(self, node: Node, *kinds: str) -> Node | None:
        """The nearest node around this one of one of these kinds."""
        n = self.parent.get(id(node))
        while n is not None and n.kind not in kinds:
            n = self.parent.get(id(n))
        return n

    def _required(self, node: Node | None) -> str | None:
        node = plain(node)
        node = plain(node.argument) if node is not None and node.kind == "Await" else node
        if node is not None and (node.kind == "ImportCall" or node.kind == "Call" and node.callee.kind == "Name" and node.callee.name == "require") and node.args:
            first = plain(node.args[0])
            if first.kind == "String" or first.kind == "Template" and not first.parts:
                return first.value if first.kind == "String" else first.texts[0]
        return None

    def _imports(self) -> None:
        """edges: (target, kind, names or * joined by commas, type only, line); exports: (name, line)."""
        self.edges, self.exports, named = [], [], set()
        for n in self.nodes:
            line = self.place(n.start)[0]
            if n.kind == "Import" and n.source is not None:
                self.edges.append((n.source, "import", ",".join(sorted({x.imported for x in n.names})), bool(n.type_only), line))
                for x in n.names:
                    self.imported[x.name] = (n.source, x.imported)
            elif n.kind == "Export" and n.source is not None:
                self.edges.append((n.source, "export", "*" if n.every else ",".join(sorted({x.imported for x in n.names})), bool(n.type_only), line))
                self.exports += [(x.name, line) for x in n.names or []]
            elif n.kind == "Export":
                self.exports += [("default", line)] if n.default else [(x.name, line) for x in n.names or []]
                d = n.declaration
                if d is not None and not n.default:
                    ids = [t for v in d.list for t, _ in targets(v.target)] if d.kind == "Variables" else [d.id] if d.id is not None else []
                    self.exports += [(x.name, self.place(x.start)[0]) for x in ids]
            elif n.kind == "Variable" and (source := self._required(n.init)) is not None:
                pattern = n.target
                names = [i.key.name for i in pattern.items if i.key is not None and i.key.kind == "Key"] if pattern.kind == "ObjectPattern" and not any(i.rest for i in pattern.items) else ["*"]
                named.add(id(plain(n.init)) if plain(n.init).kind != "Await" else id(plain(plain(n.init).argument)))
                self.edges.append((source, "require", ",".join(sorted(names)), False, line))
                if pattern.kind == "Name":
                    self.imported[pattern.name] = (source, "*")
                else:
                    for i in pattern.items:
                        if i.target.kind == "Name" and i.key is not None and i.key.kind == "Key":
                            self.imported[i.target.name] = (source, i.key.name)
        for n in self.nodes:
            if n.kind in ("ImportCall", "Call") and id(n) not in named and (source := self._required(n)) is not None:
                self.edges.append((source, "dynamic" if n.kind == "ImportCall" else "require", "*", False, self.place(n.start)[0]))
            elif n.kind == "Type" and n.source is not None:
                self.edges.append((n.source, "type", "*", True, self.place(n.start)[0]))

    def origin(self, node: Node) -> tuple[str, str]:
        """(package, name) that a callee comes from, if it was imported."""
        c = plain(node.callee)
        if c.kind == "Name":
            source, name = self.imported.get(c.name, ("", ""))
            return source.removeprefix("node:"), name
        if c.kind == "Member":
            o = plain(c.object)
            if o.kind == "Name" and o.name in self.imported:
                return self.imported[o.name][0].removeprefix("node:"), c.property
            if (source := self._required(o)) is not None:
                return source.removeprefix("node:"), c.property
        return "", ""

    # measures

    def functions(self) -> list[tuple]:
        """name, line, lines, parameters, cyclomatic, cognitive, nesting of every function with a body."""
        out = []
        for n in self.nodes:
            if n.kind in FUNCTIONS and n.body is not None:
                line = self.place(n.start)[0]
                out.append((self.function_name(n), line, self.place(max(n.start, n.end - 1))[0] - line + 1, len(n.params), *self._measure(n)))
        return out

    def function_name(self, n: Node) -> str:
        if n.id is not None:
            return n.id.name
        if n.kind == "Method":
            return n.key.name or "anonymous"
        p = self.parent.get(id(n))
        if p is not None and p.kind == "Variable" and p.target.kind == "Name":
            return p.target.name
        if p is not None and p.kind in ("Property", "Field") and p.key.kind == "Key":
            return p.key.name
        return "anonymous"

    def _measure(self, function: Node) -> tuple[int, int, int]:
        cyclomatic, cognitive, deepest = 1, 0, 0
        todo = [(function.body, 0, False)]
        while todo:
            n, depth, chained = todo.pop()
            if n.kind in FUNCTIONS:
                continue
            inside = depth
            if n.kind == "If":
                cyclomatic += 1
                cognitive += 1 if chained else 1 + depth
                deepest = max(deepest, depth + (not chained))
                level = depth if chained else depth + 1
                todo += [(n.test, depth, False), (n.then, level, False)]
                if n.other is not None:
                    todo.append((n.other, level, n.other.kind == "If"))
                continue
            if n.kind in _LOOPS or n.kind in ("Switch", "Catch"):
                cyclomatic += n.kind != "Switch"
                cognitive += 1 + depth
                inside = depth + 1
                deepest = max(deepest, inside)
            elif n.kind == "Case":
                cyclomatic += n.test is not None
            elif n.kind == "Conditional":
                cyclomatic += 1
                cognitive += 1 + depth
                todo += [(n.test, depth, False), (n.then, depth + 1, False), (n.other, depth + 1, False)]
                continue
            elif n.kind == "Binary" and n.sign in ("&&", "||", "??"):
                cyclomatic += 1
                above = self.parent.get(id(n))
                cognitive += not (above is not None and above.kind == "Binary" and above.sign == n.sign)
            todo += [(c, inside, False) for c in n.children()]
        return cyclomatic, cognitive, deepest

    def complexity(self, limits: dict[str, int]) -> None:
        for (name, line, lines, params, cyclomatic, cognitive, nesting), n in zip(self.functions(), [n for n in self.nodes if n.kind in FUNCTIONS and n.body is not None]):
            for rule, value in (("COMPLEX001", cyclomatic), ("COMPLEX002", cognitive), ("COMPLEX003", lines), ("COMPLEX004", params), ("COMPLEX005", nesting)):
                most = limits[rule]
                if value > most:
                    flat = rule == "COMPLEX001" and cognitive <= limits["COMPLEX002"]
                    self.add(rule, "LOW" if flat else "HIGH" if value >= 2 * most else "MEDIUM", "MEDIUM" if flat else "HIGH", n, f"{name}: {value}")

    # rules

    def run(self, limits: dict[str, int] | None = None) -> list[tuple]:
        self.complexity({**LIMITS, **(limits or {})})
        self.command_line = self.text.startswith("#!") or any(t in COMMAND_LINE for t, *_ in self.edges)
        for n in self.nodes:
            rule = getattr(self, "on_" + n.kind, None)
            if rule is not None:
                rule(n)
        for a, b in self.comments:
            for m in MARKER.finditer(self.text, a, b):
                self.add("HYGIENE002", "LOW", "MEDIUM", Node("Comment", m.start(), m.end()), self.text[m.start() : b].split("\n")[0])
        what = {"import": "DEAD002", "variable": "DEAD003", "function": "DEAD004", "class": "DEAD005", "parameter": "DEAD006", "type": "DEAD007"}
        for d in Analysis(self.tree).unused():
            if d.what in what:
                self.add(what[d.what], "LOW" if d.what == "parameter" else "MEDIUM", "CERTAIN", d.node, d.name)
        return sorted(self.findings, key=lambda f: (f[3], f[4], f[0]))

    def _unreachable(self, body: list[Node]) -> None:
        for before, n in zip(body, body[1:]):
            if before.kind in _EXITS:
                rest = [x for x in body[body.index(before) + 1 :] if x.kind not in ("Empty", "Interface", "TypeAlias") and not (x.kind == "Function" and x.declared)]
                if rest:
                    self.add("DEAD011", "MEDIUM", "CERTAIN", rest[0])
                return

    def on_Block(self, n: Node) -> None:
        self._unreachable(n.body)

    on_Program = on_Case = on_Block

    def on_Catch(self, n: Node) -> None:
        body = n.body
        if not body.body and not any(body.start < a < body.end for a, _ in self.comments):
            self.add("ERR001", "MEDIUM", "CERTAIN", n)
        elif len(body.body) == 1 and body.body[0].kind == "Throw":
            thrown = plain(body.body[0].argument)
            if thrown is not None and thrown.kind == "Name" and n.param is not None and n.param.kind == "Name" and n.param.name == thrown.name:
                self.add("ERR002", "LOW", "HIGH", n)

    def on_Expression(self, n: Node) -> None:
        call = plain(n.expression)
        if call.kind != "Call":
            return
        c = plain(call.callee)
        if c.kind == "Member" and c.property == "then" and len(call.args) < 2:
            chain, caught = c, False
            while chain is not None and chain.kind in ("Call", "Member"):
                caught = caught or chain.kind == "Member" and chain.property == "catch"
                chain = plain(chain.object if chain.kind == "Member" else chain.callee)
            if not caught:
                self.add("ERR004", "MEDIUM", "MEDIUM", call)
        elif c.kind == "Name" and c.name in self.async_names:
            self.add("ERR003", "MEDIUM", "LOW", call)

    @property
    def async_names(self) -> set[str]:
        """Names that stand for one function of this file, which is async."""
        if "_async" not in self.__dict__:
            made = [(self.function_name(n), bool(n.is_async)) for n in self.nodes if n.kind in ("Function", "Arrow") and n.body is not None]
            names = [m[0] for m in made]
            self._async = {n for n, a in made if a and names.count(n) == 1} - {"anonymous"}
        return self._async

    def _boolean(self, node: Node | None) -> bool:
        node = plain(node)
        if node is None:
            return False
        if node.kind == "Name":
            return node.name in self.boolean_names
        return node.kind == "Boolean" or node.kind == "Unary" and node.sign == "!" or node.kind == "Binary" and node.sign in ("==", "!=", "===", "!==", "<", ">", "<=", ">=", "in", "instanceof") or node.kind == "Binary" and node.sign in ("&&", "||") and self._boolean(node.left) and self._boolean(node.right)

    @property
    def boolean_names(self) -> set[str]:
        """Names whose every declaration in this file says boolean."""
        if "_booleans" not in self.__dict__:
            self._booleans: set[str] = set()
            says: dict[str, bool] = {}
            for n in self.nodes:
                if n.kind in ("Variable", "Parameter") and n.target.kind == "Name":
                    hint = n.hint is not None and n.hint.named == "boolean"
                    by_value = n.hint is None and n.kind == "Variable" and n.init is not None and self.parent[id(n)].how == "const" and self._boolean(n.init)
                    says[n.target.name] = says.get(n.target.name, True) and (hint or by_value)
            self._booleans = {k for k, v in says.items() if v}
        return self._booleans

    def on_Binary(self, n: Node) -> None:
        if n.sign not in ("==", "!=", "===", "!=="):
            return
        left, right = plain(n.left), plain(n.right)
        for a, b in ((left, right), (right, left)):
            if a.kind == "Boolean" and self._boolean(b):
                self.add("REDUNDANT001", "LOW", "CERTAIN", n)
                break
        loose = lambda x: x.kind == "Null" or x.kind == "Name" and x.name == "undefined" or x.kind == "Unary" and x.sign in ("typeof", "void")
        if n.sign in ("==", "!=") and not loose(left) and not loose(right):
            self.add("JS002", "LOW", "CERTAIN", n)

    def on_If(self, n: Node) -> None:
        if literal(n.test):
            self.add("REDUNDANT002", "MEDIUM", "CERTAIN", n.test)

    def on_Any(self, n: Node) -> None:
        if self.typed:
            p = self.parent.get(id(n))
            argument = p is not None and (p.kind == "Type" and p.generic or p.kind in ("TypeParameter", "Class", "Call"))
            self.add("TS001", "LOW" if argument else "MEDIUM", "MEDIUM" if argument else "CERTAIN", n, self.source(p) if p is not None else "any")

    def on_NonNull(self, n: Node) -> None:
        if self.typed:
            self.add("TS003", "LOW", "CERTAIN", n)

    def on_Variables(self, n: Node) -> None:
        if n.how == "var":
            self.add("JS001", "LOW", "CERTAIN", n)

    def on_Debugger(self, n: Node) -> None:
        self.add("HYGIENE001", "LOW", "CERTAIN", n)

    def _variable_before(self, name: str, call: Node) -> Node | None:
        """The value that the nearest declaration before a call gives a name, in the same function."""
        home = self.up(call, *FUNCTIONS, "Program")
        found = [v for v in home.walk() if v.kind == "Variable" and v.end <= call.start and v.target.kind == "Name" and v.target.name == name and self.up(v, *FUNCTIONS, "Program") is home]
        return found[-1].init if found else None

    def on_Call(self, n: Node) -> None:
        name, first = callee_name(n), n.args[0] if n.args else None
        c = plain(n.callee)
        source, imported = self.origin(n)
        if c.kind == "Member" and plain(c.object).kind == "Name" and plain(c.object).name == "console" and name in ("debug", "error", "log", "warn"):
            self.add("HYGIENE001", "LOW", "LOW" if self.command_line else "CERTAIN", n)
        if name == "eval":
            self.add("SEC002", "HIGH", "CERTAIN", n)
        if source == "child_process":
            hop = self._variable_before(plain(first).name, n) if first is not None and plain(first).kind == "Name" else None
            if imported in COMMANDS and (dynamic(first) or dynamic(hop)):
                self.add("SEC003", "HIGH", "MEDIUM", n)
            shell = any(p.kind == "Property" and p.key.name == "shell" and p.value.kind == "Boolean" and p.value.value == "true" for a in n.args if plain(a).kind == "Object" for p in plain(a).items)
            if imported in SPAWNS and shell:
                self.add("SEC003", "HIGH", "HIGH", n)
        if name == "insertAdjacentHTML" and len(n.args) > 1 and not literal(n.args[1]):
            self.add("SEC004", "MEDIUM", "HIGH", n)
        if name == "createHash" and first is not None and plain(first).kind == "String" and plain(first).value.lower() in WEAK_HASHES:
            self.add("SEC005", "MEDIUM", "HIGH", n)
        if name in QUERIES and dynamic(first) and SQL_VERB.search(self.source(first)):
            self.add("SEC008", "HIGH", "MEDIUM", n)
        joins = c.kind == "Member" and plain(c.object).kind == "Name" and plain(c.object).name == "path" and name in ("join", "resolve")
        if (joins or name in FILES) and any(REQUEST_PART.search(self.source(a)) and not SANITISED.search(self.source(a)) for a in n.args):
            self.add("SEC009", "HIGH", "LOW", n)
        if name == "unserialize" and source == "node-serialize" or name == "load" and source == "js-yaml" or name == "runInNewContext":
            self.add("SEC010", "HIGH", "MEDIUM", n)

    def on_Assign(self, n: Node) -> None:
        left = plain(n.left)
        if left.kind == "Member" and left.property in ("innerHTML", "outerHTML") and not literal(n.right):
            self.add("SEC004", "MEDIUM", "MEDIUM", n)

    def on_Attribute(self, n: Node) -> None:
        if n.name == "dangerouslySetInnerHTML" and n.value is not None and not literal(n.value):
            self.add("SEC004", "MEDIUM", "LOW" if "JSON.stringify" in self.source(n) else "MEDIUM", n)

    def on_Property(self, n: Node) -> None:
        key, value = n.key.name, plain(n.value)
        if key in ("rejectUnauthorized", "strictSSL") and value.kind == "Boolean" and value.value == "false":
            self.add("SEC007", "HIGH", "HIGH", n)
        elif key == "insecure" and value.kind == "Boolean" and value.value == "true":
            self.add("SEC007", "HIGH", "MEDIUM", n)
        elif key == "checkServerIdentity" and value.kind in ("Arrow", "Function") and (value.body.kind == "Block" and not value.body.body or plain(value.body).kind in ("Null", "Name") and plain(value.body).name in (None, "undefined")):
            self.add("SEC007", "HIGH", "HIGH", n)

    # repeated code

    def code_tokens(self) -> list[tuple[str, int]]:
        """(token, line) without imports and types; identifiers are marked by a leading 0."""
        out = []
        skip = sorted((n.start, n.end) for n in self.nodes if n.kind in ("Import", "TypeAlias", "Interface", "Declare", "TypeParameter") or n.kind in FUNCTIONS and n.body is None)
        at = 0
        for start, kind, value in self.tokens:
            while at < len(skip) and skip[at][1] <= start:
                at += 1
            if at < len(skip) and skip[at][0] <= start:
                continue
            out.append((("0" if kind == "name" and value not in _WORDS else "1") + value, self.place(start)[0]))
        return out


_WORDS = set("break case catch class const continue default delete do else export extends false finally for function if import in instanceof let new null of return static super switch this throw true try typeof undefined var void while yield async await".split())


def facts(path: str, text: str, limits: dict[str, int] | None = None) -> dict[str, list[tuple]]:
    """findings, functions, edges, exports, declared, flows and failed of one file. One that can't be read only has `failed`.

    declared: how many statements declare variables with var, and how many with let or const.
    """
    try:
        file = File(path, text)
        how = [n.how for n in file.tree.walk() if n.kind == "Variables"]
        declared = [(how.count("var"), len(how) - how.count("var"))]
        return {"findings": file.run(limits), "functions": file.functions(), "edges": file.edges, "exports": sorted(set(file.exports)), "declared": declared, "flows": flows(file), "failed": []}
    except (ParseError, RecursionError) as e:
        return {"findings": [], "functions": [], "edges": [], "exports": [], "declared": [], "flows": [], "failed": [(str(e)[:200],)]}
