"""Safe rewrites of one file: unused imports go, whole-line debug statements go, `var` becomes `const` or `let`."""

from __future__ import annotations

from .parser import ParseError, parse
from .rules import File, plain
from .scopes import FUNCTIONS, Analysis, targets


def _line(file: File, a: int, b: int) -> tuple[int, int] | None:
    """The whole line, with its end, that holds nothing but a..b."""
    start, end = a, b
    while start and file.text[start - 1] in " \t":
        start -= 1
    while end < len(file.text) and file.text[end] in " \t":
        end += 1
    if start and file.text[start - 1] not in "\r\n" or end < len(file.text) and file.text[end] not in "\r\n":
        return None
    end += 2 if file.text[end : end + 2] == "\r\n" else 1 if end < len(file.text) else 0
    return start, end


def _imports(file: File, analysis: Analysis):
    gone = {id(d.node) for d in analysis.unused() if d.what == "import"}
    for n in file.nodes:
        if n.kind != "Import" or not n.names or not any(id(x) in gone for x in n.names):
            continue
        left = [x for x in n.names if id(x) not in gone]
        if not left:
            a, b = _line(file, n.start, n.end) or (n.start, n.end)
            yield a, b, "", "DEAD002"
            continue
        first = [x.name for x in left if x.imported == "default" and file.text[: x.start].rstrip().endswith(("import", "type"))]
        star = [f"* as {x.name}" for x in left if x.imported == "*"]
        rest = [x for x in left if x.name not in first and x.imported != "*"]
        inner = [("type " if x.type_only else "") + (x.name if x.imported == x.name else f"{x.imported} as {x.name}") for x in rest]
        head = "import type " if n.type_only and not all(x.type_only for x in n.names) else "import "
        tail = file.text[n.start : n.end].rsplit("from", 1)[1]
        yield n.start, n.end, head + ", ".join([*first, *star, *(["{ " + ", ".join(inner) + " }"] if inner else [])]) + " from" + tail, "DEAD002"


def _debugs(file: File):
    for n in file.nodes:
        call = plain(n.expression) if n.kind == "Expression" else None
        debug = n.kind == "Debugger" or call is not None and call.kind == "Call" and plain(call.callee).kind == "Member" and plain(plain(call.callee).object).name == "console" and plain(call.callee).property in ("debug", "log")
        above = file.parent.get(id(n))
        if debug and above is not None and above.kind in ("Block", "Program", "Case") and (above.kind == "Program" or len(above.body) > 1):
            cut = _line(file, n.start, n.end)
            if cut is not None:
                yield *cut, "", "HYGIENE001"


def _variables(file: File):
    """Declared once, right in a function's body or at the top, and used only after that."""
    written = {plain(n.left).name for n in file.nodes if n.kind == "Assign" and plain(n.left).kind == "Name"} | {plain(n.argument).name for n in file.nodes if n.kind == "Update" and plain(n.argument).kind == "Name"}
    patterns = {x.name for n in file.nodes if n.kind == "Assign" and n.left.kind in ("Object", "Array") for x in n.left.walk() if x.kind == "Name"} | {x.name for n in file.nodes if n.kind == "ForIn" and n.left.kind != "Variables" for x in n.left.walk() if x.kind == "Name"}
    bound: dict[str, int] = {}
    for n in file.nodes:
        names = [t for v in n.list for t, _ in targets(v.target)] if n.kind == "Variables" else [t for p in n.params for t, _ in targets(p.target)] if n.kind in FUNCTIONS else []
        for t in [*names, *([n.id] if n.id is not None and n.kind in ("Function", "Class") else [])]:
            bound[t.name] = bound.get(t.name, 0) + 1
    for n in file.nodes:
        if n.kind != "Variables" or n.how != "var":
            continue
        above = file.parent.get(id(n))
        home = file.parent.get(id(above)) if above is not None and above.kind == "Block" else above
        if above is None or not (above.kind == "Program" and Analysis(file.tree).module or above.kind == "Block" and home is not None and home.kind in FUNCTIONS):
            continue
        names = {t.name for v in n.list for t, _ in targets(v.target)}
        before = any(x.kind == "Name" and x.name in names and x.start < n.start for x in file.nodes)
        if before or any(bound[x] > 1 or x in patterns for x in names):
            continue
        fixed = all(v.init is not None for v in n.list) and not names & written
        yield n.start, n.start + 3, "const" if fixed else "let", "JS001"


def plan(path: str, text: str) -> tuple[list[tuple[int, int, str, str]], str | None]:
    """Edits (start, end, text, rule) and the rewritten file; null if nothing changes, edits overlap, or the result can't be read any more."""
    try:
        file = File(path, text)
    except (ParseError, RecursionError):
        return [], None
    edits = sorted([*_imports(file, Analysis(file.tree)), *_debugs(file), *_variables(file)])
    if not edits or any(b[0] < a[1] for a, b in zip(edits, edits[1:])):
        return edits, None
    out = text
    for a, b, new, _ in reversed(edits):
        out = out[:a] + new + out[b:]
    try:
        parse(path, out)
    except ParseError:
        return edits, None
    return edits, out
