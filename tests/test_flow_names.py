"""Names that bring request data in, and calls that make it safe."""

import pytest

from lumenlint.javascript.rules import facts


def sinks(line):
    text = f"export function f(req, ctx, c, res) {{\n{line}\n}}\n"
    return {r[4] for r in facts("a.js", text)["flows"] if r[0] == "sink" and "request" in r[5]}


@pytest.mark.parametrize("source", ["req.host", "req.nextUrl", "ctx.href", "ctx.search", "ctx.request.body", "c.req.query('u')", "c.req.parseBody()", "req.header('x')"])
def test_sources(source):
    assert sinks(f"res.redirect({source});") == {"SEC012"}


@pytest.mark.parametrize("source", ["req.rawBody", "ctx.other", "c.req.valid('json')", "req.method", "other.query"])
def test_other_names(source):
    assert sinks(f"res.redirect({source});") == set()


@pytest.mark.parametrize("call, found", [("userSchema.parse(req.query.u)", set()), ("z.string().parse(req.query.u)", set()), ("JSON.parse(req.query.u)", {"SEC012"}), ("slugify(req.query.u)", set()), ("req.query.u.trim()", {"SEC012"}), ("escapeRegex(req.query.u)", {"SEC012"}), ("atob(req.query.u)", {"SEC012"})])
def test_cleaners(call, found):
    assert sinks(f"res.redirect({call});") == found
