"""What tells one block function from another, as text that is the same in every process.

It covers the function's source text and everything the function can see that may change its
result without a change of that text: values it closes over, module constants and functions it
names, and its default arguments. Functions of the block's own package are covered in the same
way; those of other packages by their name and the package's version.
"""

from __future__ import annotations

import dis
import inspect
import json
import sys
from collections.abc import Callable, Iterator
from importlib import metadata
from types import CodeType, FunctionType, MethodType, ModuleType
from typing import Any


class NoText(ValueError):
    """A function or value that has no text of its own; the block needs a version."""


def definition_text(build: Callable[..., Any], version: str | None = None) -> str:
    """The text of a block function; ``version`` stands in for it."""
    if version is not None:
        return f"{getattr(build, '__qualname__', type(build).__name__)} {version}"
    home = _package(getattr(build, "__module__", None))
    return "\n".join(_function(build, home, {}))


def _package(module: str | None) -> str:
    return (module or "").split(".")[0]


def _codes(code: CodeType) -> Iterator[CodeType]:
    """A code object and those of the functions, lambdas and comprehensions inside."""
    yield code
    for constant in code.co_consts:
        if isinstance(constant, CodeType):
            yield from _codes(constant)


def global_names(function: FunctionType) -> list[str]:
    """Names that a function looks up outside itself, also in what is nested in it."""
    found = {
        step.argval
        for code in _codes(function.__code__) for step in dis.get_instructions(code)
        if step.opname in ("LOAD_GLOBAL", "LOAD_NAME") and isinstance(step.argval, str)
    }
    return sorted(found)


def _function(build: Any, home: str, seen: dict[int, int]) -> list[str]:
    if isinstance(build, MethodType):
        raise NoText(f"{build!r} is bound to an object; give the block a version")
    if not isinstance(build, FunctionType):
        raise NoText(f"{build!r} has no source text; give the block a version")
    if id(build) in seen:
        return [f"function {seen[id(build)]}"]
    seen[id(build)] = len(seen)
    try:
        parts = [inspect.getsource(build)]
    except (OSError, TypeError) as problem:
        raise NoText(f"{build!r} has no source text; give the block a version") from problem
    held: dict[str, Any] = {}
    for name, cell in zip(build.__code__.co_freevars, build.__closure__ or (), strict=True):
        try:
            held[name] = cell.cell_contents
        except ValueError:
            # Not set yet: the name of something defined further down.
            parts.append(f"{name} is unset")
    for name in global_names(build):
        if name in build.__globals__ and name not in held:
            held[name] = build.__globals__[name]
    for number, value in enumerate(build.__defaults__ or ()):
        held[f"default {number}"] = value
    for name, value in (build.__kwdefaults__ or {}).items():
        held[f"default {name}"] = value
    for name in sorted(held):
        parts += [f"{name} =", *_value(name, held[name], home, seen)]
    return parts


def _value(name: str, value: Any, home: str, seen: dict[int, int]) -> list[str]:
    if isinstance(value, ModuleType):
        return [f"module {value.__name__} {_version(value.__name__)}"]
    if isinstance(value, type) or (callable(value) and not isinstance(value, (FunctionType, MethodType))):
        return [_named(name, value, home)]
    if isinstance(value, MethodType):
        raise NoText(f"{name!r} is bound to an object; give the block a version")
    if isinstance(value, FunctionType):
        if _package(value.__module__) != home:
            return [_named(name, value, home)]
        return _function(value, home, seen)
    try:
        return [json.dumps(value, sort_keys=True)]
    except (TypeError, ValueError) as problem:
        raise NoText(f"the value of {name!r} has no text; give the block a version") from problem


def _named(name: str, value: Any, home: str) -> str:
    """A class, or a function of another package, by its name and version."""
    module, called = getattr(value, "__module__", None), getattr(value, "__qualname__", None)
    if module is None or called is None:
        raise NoText(f"the value of {name!r} has no text; give the block a version")
    if isinstance(value, type) and _package(module) == home:
        try:
            return inspect.getsource(value)
        except (OSError, TypeError) as problem:
            raise NoText(f"{value!r} has no source text; give the block a version") from problem
    return f"{module}.{called} {_version(module)}"


def _version(module: str) -> str:
    package = _package(module)
    try:
        return metadata.version(package)
    except metadata.PackageNotFoundError:
        return str(getattr(sys.modules.get(package), "__version__", ""))
