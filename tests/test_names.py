"""Every name that a function takes from its module is there: a query without a statement of its own may run in no other test."""

import builtins
import dis
import importlib
import pkgutil
import types

import pytest

import tessera


def taken(code):
    """Global names that a function's code or that of functions in it reads."""
    for i in dis.get_instructions(code):
        if i.opname in ("LOAD_GLOBAL", "LOAD_NAME"):
            yield i.argval
    for c in code.co_consts:
        if isinstance(c, types.CodeType):
            yield from taken(c)


@pytest.mark.parametrize("name", sorted(m.name for m in pkgutil.walk_packages(tessera.__path__, "tessera.")))
def test_names_are_there(name):
    module = importlib.import_module(name)
    with open(module.__file__) as f:
        inner = [c for c in compile(f.read(), module.__file__, "exec").co_consts if isinstance(c, types.CodeType)]
    # Code in a module's own body has run with its import; class bodies have names of their own.
    functions = [c for c in inner if "__qualname__" not in c.co_names]
    assert {n for c in functions for n in taken(c)} - set(dir(module)) - set(dir(builtins)) - {"__class__"} == set()
