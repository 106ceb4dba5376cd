"""A tolerant recursive-descent parser for JavaScript and TypeScript, with JSX and decorators.

It keeps what rules and graphs need: statements, expressions, bindings, names in types, and comments. Types become nodes
that hold the names they mention. A file it can't read raises `ParseError`; the caller records that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_SPACE = re.compile(r"(?:[ \t\x0b\x0c\r\n\ufeff\u00a0\u2028\u2029]+|//[^\n\r]*|/\*.*?\*/|<!--[^\n]*)", re.S)
_TOKEN = re.compile(
    r"(?P<name>#?[A-Za-z_$\u00aa-\uffff\U00010000-\U0010ffff][\w$\u200c\u200d]*)"
    r"|(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)"
    r"|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
    r"|(?P<sign>\.\.\.|=>|>>>=|\*\*=|&&=|\|\|=|\?\?=|===|!==|<<=|>>>|>>=|\?\.(?!\d)|\?\?|&&|\|\||\+\+|--|\*\*|[-+*/%&|^]=|==|!=|<=|>=|<<|>>|[-+*/%&|^~!<>=?:;,.(){}\[\]@`])",
    re.S,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$:.-]*")
_BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8,
    "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_RESERVED = set("break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with enum".split())
_MODIFIERS = {"public", "private", "protected", "readonly", "static", "abstract", "declare", "override", "accessor", "async", "get", "set"}


class ParseError(ValueError):
    pass


class Node:
    """kind, start, end, and the fields of the kind as attributes; a field that isn't there is None."""

    def __init__(self, kind: str, start: int, end: int, **fields):
        self.kind, self.start, self.end = kind, start, end
        self.__dict__.update(fields)

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return None

    def children(self) -> Iterator[Node]:
        for v in self.__dict__.values():
            if isinstance(v, Node):
                yield v
            elif isinstance(v, list):
                yield from (x for x in v if isinstance(x, Node))

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in the order of the text."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(list(node.children())))


class Parser:
    def __init__(self, text: str, types: bool = True, jsx: bool = True):
        self.text, self.types, self.jsx = text, types, jsx
        self.comments: dict[int, tuple[int, int]] = {}
        self.tokens: dict[int, tuple[str, str]] = {}  # by where they start: (type, text)
        self.no_in = False
        self.end = 0
        if text.startswith("#!"):
            self.at = text.find("\n") if "\n" in text else len(text)
        else:
            self.at = 0
        self.advance()

    # tokens

    def advance(self) -> None:
        at, self.newline = self.at, False
        while (m := _SPACE.match(self.text, at)) is not None:
            got = m[0]
            if got[0] in "/<":
                self.comments[m.start()] = (m.start(), m.end())
            self.newline = self.newline or "\n" in got or "\r" in got
            at = m.end()
        self.start = at
        if at >= len(self.text):
            self.type, self.value, self.at = "end", "", at
            return
        m = _TOKEN.match(self.text, at)
        if m is None:
            raise ParseError(f"unexpected character at {at}")
        self.type, self.value, self.at = m.lastgroup, m[0], m.end()

    def take(self) -> str:
        value, self.end = self.value, self.at
        self.tokens[self.start] = (self.type, value)
        self.advance()
        return value

    def is_(self, *values: str) -> bool:
        return self.value in values and self.type in ("sign", "name")

    def eat(self, value: str) -> bool:
        if self.is_(value):
            self.take()
            return True
        return False

    def need(self, value: str) -> None:
        if not self.eat(value):
            raise ParseError(f"{value} wanted at {self.start}")

    def eat_right_angle(self) -> bool:
        """A single > of what may be a longer sign."""
        if self.type == "sign" and self.value.startswith(">"):
            self.at = self.start + 1
            self.end = self.at
            self.advance()
            return True
        return False

    def state(self):
        return self.at, self.start, self.end, self.type, self.value, self.newline, self.no_in

    def back(self, state) -> None:
        self.at, self.start, self.end, self.type, self.value, self.newline, self.no_in = state

    def attempt(self, parse):
        state = self.state()
        try:
            return parse()
        except ParseError:
            self.back(state)
            return None

    def peek(self) -> tuple[str, str, bool]:
        state = self.state()
        try:
            self.advance()
            return self.type, self.value, self.newline
        finally:
            self.back(state)

    def node(self, kind: str, start: int, **fields) -> Node:
        return Node(kind, start, self.end, **fields)

    def semicolon(self) -> None:
        if self.eat(";") or self.is_("}") or self.type == "end" or self.newline:
            return
        raise ParseError(f"; wanted at {self.start}")

    def name(self) -> Node:
        if self.type != "name":
            raise ParseError(f"name wanted at {self.start}")
        start = self.start
        return self.node("Name", start, name=self.take())

    # statements

    def program(self) -> Node:
        body = []
        while self.type != "end":
            body.append(self.statement())
        return Node("Program", 0, len(self.text), body=body)

    def block(self) -> Node:
        start = self.start
        self.need("{")
        body = []
        while not self.is_("}"):
            if self.type == "end":
                raise ParseError("} wanted at the end")
            body.append(self.statement())
        self.take()
        return self.node("Block", start, body=body)

    def statement(self) -> Node:
        start, value = self.start, self.value
        if self.type == "sign":
            if value == "{":
                return self.block()
            if value == ";":
                self.take()
                return self.node("Empty", start)
            if value == "@":
                marks = self.decorators()
                inner = self.statement()
                target = inner.declaration if inner.kind == "Export" and inner.declaration is not None else inner
                target.decorators = marks
                return inner
        elif self.type == "name":
            if value in ("var", "const", "let", "using") and self.starts_declaration():
                if value == "const" and self.peek()[1] == "enum":
                    self.take()
                    return self.enum(start)
                out = self.variables(start)
                self.semicolon()
                out.end = max(out.end, self.end)
                return out
            method = getattr(self, "s_" + value, None) if value in _STATEMENTS else None
            if method is not None:
                return method(start)
            if self.types or value in ("async",):
                out = self.contextual(start, value)
                if out is not None:
                    return out
            if value not in _RESERVED and self.peek()[1] == ":":
                label = self.name()
                self.take()
                return self.node("Labeled", start, label=label.name, body=self.statement())
        expression = self.expression()
        self.semicolon()
        return self.node("Expression", start, expression=expression)

    def starts_declaration(self) -> bool:
        if self.value in ("var", "const"):
            return True
        kind, value, newline = self.peek()
        if self.value == "using":
            return kind == "name" and not newline and value not in ("in", "of", "instanceof")
        return kind == "name" and value not in ("in", "instanceof", "of") or value in ("[", "{")

    def contextual(self, start: int, value: str) -> Node | None:
        kind, following, newline = self.peek()
        if value == "async" and following == "function" and not newline:
            self.take()
            return self.function(start, declaration=True, is_async=True)
        if newline or kind not in ("name", "string") and following not in ("{",):
            return None
        if value == "type" and kind == "name":
            self.take()
            name = self.name()
            params = self.type_parameters()
            self.need("=")
            of = self.type_()
            self.semicolon()
            return self.node("TypeAlias", start, id=name, params=params, of=of)
        if value == "interface" and kind == "name":
            self.take()
            name = self.name()
            params = self.type_parameters()
            bases = []
            if self.eat("extends"):
                bases.append(self.type_())
                while self.eat(","):
                    bases.append(self.type_())
            return self.node("Interface", start, id=name, params=params, bases=bases, body=self.type_primary())
        if value == "enum" and kind == "name":
            return self.enum(start)
        if value == "abstract" and following == "class":
            self.take()
            return self.s_class(start)
        if value in ("namespace", "module", "global") and (kind in ("name", "string") or value == "global" and following == "{"):
            self.take()
            name = None
            while not self.is_("{"):
                if self.type == "string":
                    self.take()
                elif self.type == "name":
                    name = name or self.name()
                    if self.is_("."):
                        self.take()
                        self.name()
                else:
                    self.semicolon()
                    return self.node("Declare", start, body=[])
                if not self.is_("{", ".") and self.type != "name":
                    self.semicolon()
                    return self.node("Declare", start, body=[])
            return self.node("Namespace", start, id=name, body=self.block())
        if value == "declare" and kind == "name":
            self.take()
            return self.node("Declare", start, body=[self.statement()])
        return None

    def enum(self, start: int) -> Node:
        self.take()
        name, members = self.name(), []
        self.need("{")
        while not self.eat("}"):
            self.property_name()
            if self.eat("="):
                members.append(self.assignment())
            if not self.eat(",") and not self.is_("}"):
                raise ParseError(f"}} wanted at {self.start}")
        return self.node("Enum", start, id=name, members=members)

    def variables(self, start: int) -> Node:
        kind, out = self.take(), []
        while True:
            at = self.start
            target = self.binding()
            self.eat("!")
            hint = self.annotation()
            init = self.assignment() if self.eat("=") else None
            out.append(self.node("Variable", at, target=target, hint=hint, init=init))
            if not self.eat(","):
                return self.node("Variables", start, how=kind, list=out)

    def s_function(self, start: int) -> Node:
        return self.function(start, declaration=True)

    def s_if(self, start: int) -> Node:
        self.take()
        test = self.parenthesised()
        then = self.statement()
        return self.node("If", start, test=test, then=then, other=self.statement() if self.eat("else") else None)

    def s_while(self, start: int) -> Node:
        self.take()
        test = self.parenthesised()
        body = self.statement()
        return self.node("While", start, test=test, body=body)

    def s_do(self, start: int) -> Node:
        self.take()
        body = self.statement()
        self.need("while")
        test = self.parenthesised()
        self.eat(";")
        return self.node("DoWhile", start, body=body, test=test)

    def s_for(self, start: int) -> Node:
        self.take()
        self.eat("await")
        self.need("(")
        init, self.no_in = None, True
        if not self.is_(";"):
            init = self.variables(self.start) if self.is_("var", "let", "const", "using") and self.starts_declaration() else self.expression()
        self.no_in = False
        if self.is_("of", "in"):
            how = self.take()
            right = self.expression()
            self.need(")")
            body = self.statement()
            return self.node("ForIn", start, left=init, how=how, right=right, body=body)
        self.need(";")
        test = None if self.is_(";") else self.expression()
        self.need(";")
        step = None if self.is_(")") else self.expression()
        self.need(")")
        body = self.statement()
        return self.node("For", start, init=init, test=test, step=step, body=body)

    def s_return(self, start: int) -> Node:
        kind = {"return": "Return", "throw": "Throw"}[self.take()]
        argument = None if self.is_(";", "}") or self.type == "end" or self.newline else self.expression()
        self.semicolon()
        return self.node(kind, start, argument=argument)

    s_throw = s_return

    def s_break(self, start: int) -> Node:
        kind = self.take().capitalize()
        if self.type == "name" and not self.newline and self.value not in _RESERVED:
            self.take()
        self.semicolon()
        return self.node(kind, start)

    s_continue = s_debugger = s_break

    def s_try(self, start: int) -> Node:
        self.take()
        block, handler, last = self.block(), None, None
        at = self.start
        if self.eat("catch"):
            param = None
            if self.eat("("):
                param = self.binding()
                self.annotation()
                self.need(")")
            body = self.block()
            handler = self.node("Catch", at, param=param, body=body)
        if self.eat("finally"):
            last = self.block()
        return self.node("Try", start, block=block, handler=handler, last=last)

    def s_switch(self, start: int) -> Node:
        self.take()
        of, cases = self.parenthesised(), []
        self.need("{")
        while not self.eat("}"):
            at, test = self.start, None
            if self.eat("case"):
                test = self.expression()
            else:
                self.need("default")
            self.need(":")
            body = []
            while not self.is_("case", "default", "}"):
                if self.type == "end":
                    raise ParseError("} wanted at the end")
                body.append(self.statement())
            cases.append(self.node("Case", at, test=test, body=body))
        return self.node("Switch", start, of=of, cases=cases)

    def s_class(self, start: int) -> Node:
        out = self.class_(start)
        out.declared = True
        return out

    def s_import(self, start: int) -> Node:
        _, following, _ = self.peek()
        if following in ("(", "."):
            expression = self.expression()
            self.semicolon()
            return self.node("Expression", start, expression=expression)
        self.take()
        names, whole, type_only = [], False, False
        if self.is_("type") and self.peek()[1] not in ("from", ",") or self.is_("type") and self.peek()[1] == "from" and self.text[self.at :].lstrip().startswith("from from"):
            self.take()
            type_only = True
        if self.type == "string":
            source = self.string()
            self.clause()
            self.semicolon()
            return self.node("Import", start, source=source, names=[], bare=True)
        if self.type == "name":
            local = self.name()
            if self.eat("="):  # import x = require('y')
                value = self.expression()
                self.semicolon()
                source = value.args[0].value if value.kind == "Call" and value.args and value.args[0].kind == "String" else None
                local.imported = "*"
                return self.node("Import", start, source=source, names=[local], whole=True)
            local.imported = "default"
            names.append(local)
            self.eat(",")
        if self.eat("*"):
            self.need("as")
            local = self.name()
            local.imported, whole = "*", True
            names.append(local)
        elif self.eat("{"):
            names += self.specifiers()
        self.need("from")
        source = self.string()
        self.clause()
        self.semicolon()
        type_only = type_only or bool(names) and all(n.type_only for n in names)
        return self.node("Import", start, source=source, names=names, whole=whole, type_only=type_only)

    def clause(self) -> None:
        if self.is_("with", "assert") and self.peek()[1] == "{":
            self.take()
            self.primary()

    def specifiers(self) -> list[Node]:
        """name [as local] of an import or export list; `imported` is the other side's name."""
        out = []
        while not self.eat("}"):
            type_only = False
            if self.is_("type") and self.peek()[1] not in (",", "}", "as"):
                self.take()
                type_only = True
            start = self.start
            outer = self.string() if self.type == "string" else self.name().name
            local = self.node("Name", start, name=outer)
            if self.eat("as"):
                start = self.start
                local = Node("Name", start, self.at, name=self.string() if self.type == "string" else self.name().name)
            local.imported, local.type_only = outer, type_only
            out.append(local)
            if not self.eat(",") and not self.is_("}"):
                raise ParseError(f"}} wanted at {self.start}")
        return out

    def s_export(self, start: int) -> Node:
        self.take()
        if self.eat("default"):
            at = self.start
            if self.is_("function") or self.is_("async") and self.peek()[1] == "function":
                is_async = self.eat("async")
                inner = self.function(at, declaration=True, is_async=is_async)
            elif self.is_("class", "@") or self.is_("abstract"):
                self.eat("abstract")
                marks = self.decorators() if self.is_("@") else None
                inner = self.s_class(at)
                inner.decorators = marks
            elif self.is_("interface"):
                inner = self.statement()
            else:
                inner = self.assignment()
                self.semicolon()
            return self.node("Export", start, declaration=inner, default=True)
        type_only = False
        if self.is_("type") and self.peek()[1] in ("{", "*"):
            self.take()
            type_only = True
        if self.eat("*"):
            named = self.name_or_string() if self.eat("as") else None
            self.need("from")
            source = self.string()
            self.clause()
            self.semicolon()
            return self.node("Export", start, source=source, every=True, named=named, type_only=type_only)
        if self.eat("{"):
            names = self.specifiers()
            source = None
            if self.eat("from"):
                source = self.string()
                self.clause()
            self.semicolon()
            return self.node("Export", start, names=names, source=source, type_only=type_only)
        if self.eat("="):
            inner = self.expression()
            self.semicolon()
            return self.node("Export", start, declaration=inner, default=True)
        if self.eat("as"):
            self.need("namespace")
            self.name()
            self.semicolon()
            return self.node("Export", start, names=[])
        if self.is_("import"):
            return self.statement()
        return self.node("Export", start, declaration=self.statement())

    def name_or_string(self) -> str:
        return self.string() if self.type == "string" else self.name().name

    def string(self) -> str:
        if self.type != "string":
            raise ParseError(f"string wanted at {self.start}")
        return unquote(self.take())

    def parenthesised(self) -> Node:
        self.need("(")
        out = self.expression()
        self.need(")")
        return out

    # functions and classes

    def decorators(self) -> list[Node]:
        out = []
        while self.eat("@"):
            out.append(self.call_chain(self.primary(), self.start))
        return out

    def parameters(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.eat(")"):
            start, marks = self.start, self.decorators()
            access = False
            while self.is_("public", "private", "protected", "readonly", "override") and self.peek()[1] not in (",", ")", "=", ":", "?"):
                self.take()
                access = True
            rest = self.eat("...")
            target = self.binding()
            self.eat("?")
            hint = self.annotation()
            default = self.assignment() if self.eat("=") else None
            out.append(self.node("Parameter", start, target=target, hint=hint, default=default, rest=rest, decorators=marks, access=access))
            if not self.eat(",") and not self.is_(")"):
                raise ParseError(f") wanted at {self.start}")
        return out

    def function(self, start: int, declaration: bool = False, is_async: bool = False) -> Node:
        self.need("function")
        star = self.eat("*")
        name = self.name() if self.type == "name" else None
        return self.rest_of_function(start, "Function", id=name, declared=declaration, is_async=is_async, star=star)

    def rest_of_function(self, start: int, kind: str, **fields) -> Node:
        generics = self.type_parameters()
        no_in, self.no_in = self.no_in, False
        params = self.parameters()
        returns = self.annotation()
        body = None
        if self.is_("{"):
            body = self.block()
        else:
            self.semicolon()
        self.no_in = no_in
        return self.node(kind, start, params=params, generics=generics, returns=returns, body=body, **fields)

    def class_(self, start: int) -> Node:
        self.need("class")
        name = self.name() if self.type == "name" and self.value not in ("extends", "implements") else None
        generics, base, kinds = self.type_parameters(), None, []
        if self.eat("extends"):
            base = self.call_chain(self.primary(), self.start)
            if self.is_("<"):
                kinds += self.type_arguments()
        if self.eat("implements"):
            kinds.append(self.type_())
            while self.eat(","):
                kinds.append(self.type_())
        self.need("{")
        members = []
        while not self.eat("}"):
            if not self.eat(";"):
                members.append(self.member())
        return self.node("Class", start, id=name, generics=generics, base=base, implements=kinds, members=members)

    def member(self) -> Node:
        start, marks, how = self.start, self.decorators(), set()
        while self.type == "name" and self.value in _MODIFIERS:
            kind, following, newline = self.peek()
            if following in ("(", "=", ";", ":", "?", "!", "}", "<", ",") or newline and self.value not in ("public", "private", "protected", "static"):
                break
            if self.value == "static" and following == "{":
                self.take()
                return self.node("Static", start, body=self.block())
            how.add(self.take())
        star = self.eat("*")
        key = self.property_name()
        if key.kind == "Index":
            self.eat(";")
            return self.node("Field", start, key=key)
        self.eat("?") or self.eat("!")
        if self.is_("(", "<"):
            return self.rest_of_function(start, "Method", key=key, how=how, is_async="async" in how, star=star, decorators=marks)
        hint = self.annotation()
        init = self.assignment() if self.eat("=") else None
        self.semicolon()
        return self.node("Field", start, key=key, hint=hint, init=init, decorators=marks)

    def property_name(self) -> Node:
        start = self.start
        if self.eat("["):
            if self.types and self.type == "name" and self.peek()[1] == ":":  # an index signature
                self.name()
                self.annotation()
                self.need("]")
                return self.node("Index", start, hint=self.annotation())
            inner = self.assignment()
            self.need("]")
            return self.node("Computed", start, expression=inner)
        if self.type == "string":
            return self.node("Key", start, name=self.string())
        if self.type in ("name", "number"):
            return self.node("Key", start, name=self.take())
        raise ParseError(f"property wanted at {self.start}")

    def binding(self) -> Node:
        start = self.start
        if self.eat("["):
            items = []
            while not self.eat("]"):
                if self.eat(","):
                    continue
                rest = self.eat("...")
                item = self.binding()
                default = self.assignment() if self.eat("=") else None
                items.append(self.node("Element", item.start, target=item, default=default, rest=rest))
                if not self.eat(",") and not self.is_("]"):
                    raise ParseError(f"] wanted at {self.start}")
            return self.node("ArrayPattern", start, items=items)
        if self.eat("{"):
            items = []
            while not self.eat("}"):
                at, rest = self.start, self.eat("...")
                if rest:
                    target, key, short = self.binding(), None, False
                else:
                    key = self.property_name()
                    short = not self.eat(":")
                    target = Node("Name", key.start, key.end, name=key.name) if short else self.binding()
                default = self.assignment() if self.eat("=") else None
                items.append(self.node("Element", at, key=key, target=target, default=default, rest=rest))
                if not self.eat(",") and not self.is_("}"):
                    raise ParseError(f"}} wanted at {self.start}")
            return self.node("ObjectPattern", start, items=items)
        if self.type == "name" and (self.value not in _RESERVED or self.value == "this"):
            return self.name()
        raise ParseError(f"binding wanted at {self.start}")

    # types

    def annotation(self) -> Node | None:
        if not self.types or not self.eat(":"):
            return None
        start = self.start
        if self.is_("asserts") and self.peek()[0] == "name":
            self.take()
        if self.type == "name" and self.peek()[1] == "is":
            self.take()
            self.take()
            return self.node("Type", start, parts=[self.type_()])
        out = self.type_()
        if self.eat("is"):
            out = self.node("Type", start, parts=[self.type_()])
        return out

    def type_parameters(self) -> list[Node] | None:
        if not self.types or not self.is_("<"):
            return None
        self.take()
        out = []
        while not self.eat_right_angle():
            while self.is_("const", "in", "out") and self.peek()[0] == "name":
                self.take()
            name = self.name()
            parts = []
            if self.eat("extends"):
                parts.append(self.type_())
            if self.eat("="):
                parts.append(self.type_())
            out.append(self.node("TypeParameter", name.start, id=name, parts=parts))
            if not self.eat(",") and not self.value.startswith(">"):
                raise ParseError(f"> wanted at {self.start}")
        return out

    def type_arguments(self) -> list[Node]:
        self.need("<")
        out = []
        while not self.eat_right_angle():
            out.append(self.type_())
            if not self.eat(",") and not self.value.startswith(">"):
                raise ParseError(f"> wanted at {self.start}")
        return out

    def type_(self) -> Node:
        start = self.start
        left = self.type_union()
        if self.is_("extends") and not self.newline:
            self.take()
            parts = [left, self.type_union()]
            if self.eat("?"):
                parts.append(self.type_())
                self.need(":")
                parts.append(self.type_())
            return self.node("Type", start, parts=parts)
        return left

    def type_union(self) -> Node:
        start = self.start
        self.eat("|") or self.eat("&")
        parts = [self.type_postfix()]
        while self.is_("|", "&"):
            self.take()
            parts.append(self.type_postfix())
        return parts[0] if len(parts) == 1 else self.node("Type", start, parts=parts, union=True)

    def type_postfix(self) -> Node:
        start = self.start
        out = self.type_primary()
        while self.is_("[") and not self.newline:
            self.take()
            if self.eat("]"):
                out = self.node("Type", start, parts=[out])
            else:
                index = self.type_()
                self.need("]")
                out = self.node("Type", start, parts=[out, index])
        return out

    def type_primary(self) -> Node:
        start = self.start
        if self.type in ("string", "number"):
            self.take()
            return self.node("Type", start, parts=[])
        if self.is_("-"):
            self.take()
            return self.type_primary()
        if self.is_("`"):
            return self.node("Type", start, parts=[self.template(types=True)])
        if self.is_("<") or self.is_("("):
            function = self.attempt(lambda: self.function_type(start))
            if function is not None:
                return function
            self.need("(")
            inner = self.type_()
            self.need(")")
            return inner
        if self.eat("["):
            parts = []
            while not self.eat("]"):
                self.eat("...")
                if self.type == "name" and self.peek()[1] in (":", "?"):
                    self.take()
                    if self.eat("?"):
                        pass
                    if self.eat(":"):
                        parts.append(self.type_())
                else:
                    parts.append(self.type_())
                    self.eat("?")
                if not self.eat(",") and not self.is_("]"):
                    raise ParseError(f"] wanted at {self.start}")
            return self.node("Type", start, parts=parts)
        if self.eat("{"):
            return self.object_type(start)
        if self.type != "name":
            raise ParseError(f"type wanted at {self.start}")
        value = self.value
        if value in ("keyof", "unique", "readonly", "infer") and (self.peek()[0] == "name" or self.peek()[1] in ("(", "[", "{")):
            self.take()
            if value == "infer":
                name = self.name()
                if self.is_("extends"):
                    self.attempt(lambda: (self.take(), self.type_union()))
                return self.node("Type", start, parts=[], infer=name.name)
            return self.node("Type", start, parts=[self.type_postfix()])
        if value in ("new", "abstract") and self.peek()[1] in ("(", "<", "new"):
            self.take()
            self.eat("new")
            return self.function_type(start)
        if value == "typeof":
            self.take()
            if self.is_("import"):
                return self.type_primary()
            name = self.name()
            while self.eat("."):
                self.name()
            parts = self.type_arguments() if self.is_("<") and not self.newline else []
            return self.node("Type", start, parts=[name, *parts])
        if value == "import":
            self.take()
            self.need("(")
            source = self.string()
            self.need(")")
            while self.eat("."):
                self.name()
            parts = self.type_arguments() if self.is_("<") else []
            return self.node("Type", start, parts=parts, source=source)
        name = self.take()
        first = Node("TypeName", start, self.end, name=name)
        while self.eat("."):
            self.name()
        parts = self.type_arguments() if self.is_("<") and not self.newline else []
        if name == "any":
            return self.node("Any", start)
        return self.node("Type", start, parts=[first, *parts], named=name, generic=bool(parts))

    def function_type(self, start: int) -> Node:
        generics = self.type_parameters()
        params = self.parameters()
        self.need("=>")
        state, self.at = self.state(), self.at
        asserts = self.attempt(lambda: self.predicate())
        if asserts is None:
            self.back(state)
            asserts = self.type_()
        return self.node("FunctionType", start, generics=generics, params=params, returns=asserts)

    def predicate(self) -> Node:
        start = self.start
        self.eat("asserts")
        self.name()
        if not self.eat("is"):
            raise ParseError("no predicate")
        return self.node("Type", start, parts=[self.type_()])

    def object_type(self, start: int) -> Node:
        parts = []
        while not self.eat("}"):
            while self.is_("+", "-") or self.is_("readonly", "get", "set", "static") and self.peek()[1] not in ("(", ":", "?", ",", ";", "}", "<"):
                self.take()
            if self.is_("new") and self.peek()[1] in ("(", "<"):
                self.take()
            if self.is_("["):
                mapped = self.attempt(self.mapped)
                key = mapped if mapped is not None else self.property_name()
                parts.append(key)
            elif not self.is_("(", "<"):
                self.property_name()
            while self.is_("+", "-", "?"):
                self.take()
            if self.is_("(", "<"):
                generics = self.type_parameters()
                at = self.start
                params = self.parameters()
                parts.append(self.node("FunctionType", at, generics=generics, params=params, returns=self.annotation()))
            else:
                hint = self.annotation()
                if hint is not None:
                    parts.append(hint)
            if not (self.eat(";") or self.eat(",")) and not self.is_("}") and not self.newline:
                raise ParseError(f"}} wanted at {self.start}")
        return self.node("Type", start, parts=parts)

    def mapped(self) -> Node:
        start = self.start
        self.need("[")
        name = self.name()
        self.need("in")
        parts = [self.type_()]
        if self.eat("as"):
            parts.append(self.type_())
        self.need("]")
        return self.node("Type", start, parts=parts, infer=name.name)

    # expressions

    def expression(self) -> Node:
        start = self.start
        out = self.assignment()
        if not self.is_(","):
            return out
        items = [out]
        while self.eat(","):
            items.append(self.assignment())
        return self.node("Sequence", start, items=items)

    def assignment(self) -> Node:
        start = self.start
        arrow = self.arrow(start)
        if arrow is not None:
            return arrow
        if self.is_("yield"):
            self.take()
            self.eat("*")
            stop = self.is_(")", "]", "}", ",", ";", ":") or self.type == "end" or self.newline
            return self.node("Yield", start, argument=None if stop else self.assignment())
        left = self.conditional()
        if self.type == "sign" and self.value in _ASSIGN:
            sign = self.take()
            return self.node("Assign", start, sign=sign, left=left, right=self.assignment())
        return left

    def arrow(self, start: int) -> Node | None:
        if self.type == "name" and self.value not in _RESERVED:
            kind, following, newline = self.peek()
            if following == "=>" and kind == "sign":
                name = self.name()
                return self.arrow_body(start, [Node("Parameter", name.start, name.end, target=name)], False, None)
            if self.value == "async" and not newline and (kind == "name" and following not in ("in", "of", "instanceof", "as") or following in ("(", "<")):

                def parse() -> Node:
                    self.take()
                    if self.type == "name":
                        name = self.name()
                        if not self.is_("=>"):
                            raise ParseError("no arrow")
                        return self.arrow_body(start, [Node("Parameter", name.start, name.end, target=name)], True, None)
                    return self.arrow_head(start, True)

                return self.attempt(parse) if following != "function" else None
        if self.is_("(") or self.is_("<") and self.types:
            return self.attempt(lambda: self.arrow_head(start, False))
        return None

    def arrow_head(self, start: int, is_async: bool) -> Node:
        generics = self.type_parameters()
        params = self.parameters()
        returns = self.annotation()
        if not self.is_("=>") or self.newline:
            raise ParseError("no arrow")
        return self.arrow_body(start, params, is_async, generics, returns)

    def arrow_body(self, start: int, params: list[Node], is_async: bool, generics, returns=None) -> Node:
        self.need("=>")
        if self.is_("{"):
            no_in, self.no_in = self.no_in, False
            body = self.block()
            self.no_in = no_in
        else:
            body = self.assignment()
        return self.node("Arrow", start, params=params, generics=generics, returns=returns, is_async=is_async, body=body)

    def conditional(self) -> Node:
        start = self.start
        test = self.binary(0)
        if not self.is_("?"):
            return test
        self.take()
        no_in, self.no_in = self.no_in, False
        then = self.assignment()
        self.no_in = no_in
        self.need(":")
        return self.node("Conditional", start, test=test, then=then, other=self.assignment())

    def binary(self, least: int) -> Node:
        start = self.start
        left = self.unary()
        while True:
            sign = self.value if self.type in ("sign", "name") else ""
            if self.types and sign in ("as", "satisfies") and self.type == "name" and not self.newline:
                self.take()
                hint = self.node("Type", self.start, parts=[]) if self.eat("const") else self.type_()
                left = self.node("As", start, expression=left, hint=hint)
                continue
            power = _BINARY.get(sign)
            if power is None or power <= least or sign == "in" and self.no_in:
                return left
            self.take()
            right = self.binary(power - 1 if sign == "**" else power)
            left = self.node("Binary", start, sign=sign, left=left, right=right)

    def unary(self) -> Node:
        start = self.start
        if self.type == "sign" and self.value in ("!", "~", "+", "-", "++", "--"):
            sign = self.take()
            argument = self.unary()
            return self.node("Update" if sign in ("++", "--") else "Unary", start, sign=sign, argument=argument)
        if self.type == "name" and self.value in ("typeof", "void", "delete", "await"):
            if self.value != "await" or self.peek()[1] not in (")", ",", ";", "=", ".", ":", "]", "}"):
                sign = self.take()
                return self.node("Await" if sign == "await" else "Unary", start, sign=sign, argument=self.unary())
        if self.is_("<") and self.types and not self.jsx:
            self.take()
            hint = self.type_()
            if not self.eat_right_angle():
                raise ParseError(f"> wanted at {self.start}")
            return self.node("As", start, hint=hint, expression=self.unary())
        out = self.call_chain(self.primary(), start)
        if self.is_("++", "--") and not self.newline:
            return self.node("Update", start, sign=self.take(), argument=out)
        return out

    def arguments(self) -> list[Node]:
        self.need("(")
        no_in, self.no_in = self.no_in, False
        out = []
        while not self.eat(")"):
            start = self.start
            if self.eat("..."):
                out.append(self.node("Spread", start, argument=self.assignment()))
            else:
                out.append(self.assignment())
            if not self.eat(",") and not self.is_(")"):
                raise ParseError(f") wanted at {self.start}")
        self.no_in = no_in
        return out

    def call_chain(self, out: Node, start: int, calls: bool = True) -> Node:
        start = out.start
        while True:
            if self.is_(".") or self.is_("?."):
                optional = self.take() == "?."
                if optional and self.is_("("):
                    out = self.node("Call", start, callee=out, args=self.arguments())
                elif optional and self.is_("["):
                    continue
                else:
                    name = self.name()
                    out = self.node("Member", start, object=out, property=name.name, at=name.start)
            elif self.is_("["):
                self.take()
                no_in, self.no_in = self.no_in, False
                index = self.expression()
                self.no_in = no_in
                self.need("]")
                out = self.node("Element", start, object=out, index=index)
            elif self.is_("(") and calls:
                args = self.arguments()
                out = self.node("Call", start, callee=out, args=args)
            elif self.is_("`"):
                out = self.node("Tagged", start, tag=out, quasi=self.template())
            elif self.types and self.is_("!") and not self.newline and self.text[self.start + 1 : self.start + 2] != "=":
                self.take()
                out = self.node("NonNull", start, expression=out)
            elif self.types and self.is_("<", "<<"):
                inner = out

                def generic() -> Node:
                    types = self.type_arguments()
                    if calls and self.is_("("):
                        return self.node("Call", start, callee=inner, types=types, args=self.arguments())
                    if self.is_("`") or not self.is_("(") and (self.is_(")", "]", ",", ";", ":", "}", ".") or self.type == "end" or self.newline):
                        return self.node("Instantiated", start, expression=inner, types=types)
                    if not calls and self.is_("("):
                        return self.node("Instantiated", start, expression=inner, types=types)
                    raise ParseError("no type arguments")

                got = self.attempt(generic) if self.is_("<") else None
                if got is None:
                    return out
                out = got
            else:
                return out

    def primary(self) -> Node:
        start, value = self.start, self.value
        if self.type == "number":
            return self.node("Number", start, value=self.take())
        if self.type == "string":
            return self.node("String", start, value=self.string())
        if self.type == "sign":
            if value == "(":
                self.take()
                no_in, self.no_in = self.no_in, False
                inner = self.expression()
                self.no_in = no_in
                self.need(")")
                return self.node("Paren", start, expression=inner)
            if value == "[":
                return self.array(start)
            if value == "{":
                return self.object(start)
            if value == "`":
                return self.template()
            if value in ("/", "/="):
                m = _REGEX.match(self.text, self.start)
                if m is None:
                    raise ParseError(f"regular expression wanted at {start}")
                self.at = self.end = m.end()
                self.advance()
                return self.node("Regex", start, value=m[0])
            if value == "<" and self.jsx:
                return self.element(start)
            if value == "@":
                self.decorators()
                return self.class_(self.start)
        if self.type == "name":
            if value == "function":
                return self.function(start)
            if value == "async" and self.peek()[1] == "function" and not self.peek()[2]:
                self.take()
                return self.function(start, is_async=True)
            if value == "class":
                return self.class_(start)
            if value == "new":
                self.take()
                if self.eat("."):
                    self.name()
                    return self.node("Meta", start)
                callee = self.call_chain(self.primary(), self.start, calls=False)
                return self.node("New", start, callee=callee, args=self.arguments() if self.is_("(") else [])
            if value == "import":
                self.take()
                if self.eat("."):
                    self.name()
                    return self.node("Meta", start)
                return self.node("ImportCall", start, args=self.arguments())
            if value in ("true", "false", "null", "this", "super"):
                return self.node({"true": "Boolean", "false": "Boolean", "null": "Null"}.get(self.take(), "This"), start, value=value)
            if value not in _RESERVED:
                return self.name()
        raise ParseError(f"expression wanted at {self.start}")

    def array(self, start: int) -> Node:
        self.take()
        items = []
        while not self.eat("]"):
            if self.eat(","):
                continue
            at = self.start
            items.append(self.node("Spread", at, argument=self.assignment()) if self.eat("...") else self.assignment())
            if not self.eat(",") and not self.is_("]"):
                raise ParseError(f"] wanted at {self.start}")
        return self.node("Array", start, items=items)

    def object(self, start: int) -> Node:
        self.take()
        no_in, self.no_in = self.no_in, False
        items = []
        while not self.eat("}"):
            at = self.start
            if self.eat("..."):
                items.append(self.node("Spread", at, argument=self.assignment()))
            else:
                how = set()
                while self.is_("get", "set", "async") and self.peek()[1] not in ("(", ":", ",", "}", "=", "<"):
                    how.add(self.take())
                star = self.eat("*")
                key = self.property_name()
                if self.is_("(", "<"):
                    items.append(self.rest_of_function(at, "Method", key=key, how=how, is_async="async" in how, star=star))
                elif self.eat(":"):
                    items.append(self.node("Property", at, key=key, value=self.assignment()))
                else:
                    value = Node("Name", key.start, key.end, name=key.name)
                    if self.eat("="):  # a pattern's default
                        value = self.node("Assign", at, sign="=", left=value, right=self.assignment())
                    items.append(self.node("Property", at, key=key, value=value, short=True))
            if not self.eat(",") and not self.is_("}"):
                raise ParseError(f"}} wanted at {self.start}")
        self.no_in = no_in
        return self.node("Object", start, items=items)

    def template(self, types: bool = False) -> Node:
        start, at, parts, texts = self.start, self.start + 1, [], []
        while True:
            m = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S).match(self.text, at)
            texts.append(m[0])
            at = m.end()
            if self.text.startswith("${", at):
                self.at = at + 2
                self.advance()
                parts.append(self.type_() if types else self.expression())
                if not self.is_("}"):
                    raise ParseError(f"}} wanted at {self.start}")
                at = self.start + 1
            elif self.text.startswith("`", at):
                self.at = self.end = at + 1
                self.advance()
                return self.node("Template", start, parts=parts, texts=texts)
            else:
                raise ParseError("` wanted at the end")

    # JSX

    def element(self, start: int) -> Node:
        at = self.skip(start + 1)
        m = _JSX_NAME.match(self.text, at)
        tag = m[0] if m else ""
        at = self.skip(m.end() if m else at)
        attributes, children = [], []
        if tag and self.types and self.text.startswith("<", at):
            self.at = at
            self.advance()
            children += self.type_arguments()
            at = self.start
        while not self.text.startswith((">", "/>"), at):
            if self.text.startswith("{", at):
                inner, at = self.braces(at)
                attributes.append(Node("Spread", at, at, argument=inner))
            elif m := _JSX_NAME.match(self.text, at):
                name, begun, value = m[0], at, None
                at = self.skip(m.end())
                if self.text.startswith("=", at):
                    at = self.skip(at + 1)
                    if self.text[at : at + 1] in "\"'":
                        close = self.text.find(self.text[at], at + 1)
                        if close < 0:
                            raise ParseError("quote wanted")
                        value, at = Node("String", at, close + 1, value=self.text[at + 1 : close]), close + 1
                    elif self.text.startswith("{", at):
                        value, at = self.braces(at)
                    else:
                        self.at = at
                        self.advance()
                        value = self.element(self.start)
                        at = value.end
                attributes.append(Node("Attribute", begun, at, name=name, value=value))
            else:
                raise ParseError(f"attribute wanted at {at}")
            at = self.skip(at)
        if self.text.startswith("/>", at):
            at += 2
        else:
            at += 1
            while True:
                cut = re.compile(r"[<{]").search(self.text, at)
                if cut is None:
                    raise ParseError("closing tag wanted")
                at = cut.start()
                if self.text[at] == "{":
                    inner, at = self.braces(at)
                    if inner is not None:
                        children.append(inner)
                elif self.text.startswith("/", self.skip(at + 1)):
                    at = self.text.find(">", at) + 1
                    break
                else:
                    child = self.element(at)
                    children.append(child)
                    at = child.end
        self.at = self.end = at
        self.advance()
        return Node("Jsx", start, at, tag=tag, attributes=attributes, items=children)

    def skip(self, at: int) -> int:
        while (m := _SPACE.match(self.text, at)) is not None:
            at = m.end()
        return at

    def braces(self, at: int) -> tuple[Node | None, int]:
        """The expression in braces at `at`, and where it ends; none for a comment."""
        self.at = at + 1
        self.advance()
        self.eat("...")
        inner = None if self.is_("}") else self.expression()
        if not self.is_("}"):
            raise ParseError(f"}} wanted at {self.start}")
        return inner, self.start + 1


_STATEMENTS = {"function", "if", "while", "do", "for", "return", "throw", "break", "continue", "debugger", "try", "switch", "class", "import", "export"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}


def unquote(literal: str) -> str:
    def one(m: re.Match) -> str:
        s = m[1]
        if s[0] in "xu" and len(s) > 1:
            return chr(int(s[1:].strip("{}"), 16))
        return _ESCAPES.get(s, s)

    return re.sub(r"\\(x[\da-fA-F]{2}|u[\da-fA-F]{4}|u\{[\da-fA-F]{1,5}\}|.)", one, literal[1:-1], flags=re.S) if "\\" in literal else literal[1:-1]


def parse(path: str, text: str) -> tuple[Node, list[tuple[int, int]], list[tuple[int, str, str]]]:
    """The tree of a file, its comments as (start, end), and its tokens as (start, type, text). The path's extension chooses the language."""
    extension = path.rsplit(".", 1)[-1].lower()
    kinds = [(True, False)] if extension in ("ts", "mts", "cts") else [(True, True)] if extension == "tsx" else [(False, True), (True, True)]
    for at, (types, jsx) in enumerate(kinds):
        try:
            parser = Parser(text, types, jsx)
            tree = parser.program()
            return tree, sorted(parser.comments.values()), [(k, *v) for k, v in sorted(parser.tokens.items())]
        except (ParseError, RecursionError) as e:
            if at == len(kinds) - 1:
                raise ParseError(str(e)) from e
    raise AssertionError
