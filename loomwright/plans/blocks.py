"""Rule bodies that are programs: shell commands, inline code and script files, run on the driver beside a local root.

They are for small steps around the tables (a rule's data work is SQL or a function over DataFrames).  A Python block
finds ``input``, ``output``, ``params``, ``wildcards`` and ``resources`` as values with names and places."""

from __future__ import annotations

import json
import os
import signal
import subprocess
from collections.abc import Callable

#: Interpreters by language and by a script's extension.
INTERPRETERS = {"python": "python3", "python3": "python3", "bash": "bash", "sh": "sh", "r": "Rscript", "perl": "perl"}
EXTENSIONS = {"py": "python", "sh": "sh", "bash": "bash", "r": "r", "pl": "perl"}
PREAMBLE = """import json as _json


class _Files(list):
    def __init__(self, pairs):
        super().__init__(p for _, p in pairs)
        for name in dict.fromkeys(n for n, _ in pairs if n):
            own = [p for n, p in pairs if n == name]
            setattr(self, name, own[0] if len(own) == 1 else own)

    def __str__(self):
        return " ".join(self)


class _Named(dict):
    __getattr__ = dict.__getitem__


_given = _json.loads({given!r})
input, output = _Files(_given["input"]), _Files(_given["output"])
params, wildcards, resources = (_Named(_given[k]) for k in ("params", "wildcards", "resources"))
"""


class BlockError(RuntimeError):
    """A program that failed, was stopped, or left an output out."""


def interpreter(lang: str | None, script: str | None = None) -> str:
    lang = lang or EXTENSIONS.get((script or "").rsplit(".", 1)[-1].lower(), "python" if script is None else "sh")
    return INTERPRETERS.get(lang.lower(), lang)


def preamble(given: dict) -> str:
    """What stands before an inline Python block; ``given``: input and output as (name, path), params, wildcards,
    resources."""
    return PREAMBLE.format(given=json.dumps(given))


def execute(arguments: list[str], root: str, outputs: list[str], stopped: Callable[[], bool] = lambda: False, timeout: float | None = None) -> None:
    """Runs a program in ``root`` until it ends, is told to stop or runs out of time; its outputs must be there then."""
    if not os.path.isdir(root):
        raise BlockError(f"programs need a local folder, not {root}")
    for path in outputs:
        os.makedirs(os.path.dirname(os.path.join(root, path)) or root, exist_ok=True)
    with subprocess.Popen(arguments, cwd=root, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True, start_new_session=True) as child:
        waited, text = 0.0, ""
        while True:
            try:
                text, _ = child.communicate(timeout=0.1)
                break
            except subprocess.TimeoutExpired:
                waited += 0.1
                late = timeout is not None and waited >= timeout
                if late or stopped():
                    os.killpg(child.pid, signal.SIGKILL)
                    child.communicate()
                    raise BlockError(f"timed out after {timeout:g} s" if late else "stopped") from None
    if child.returncode:
        lines = [x.strip() for x in text.splitlines() if x.strip()]
        raise BlockError(f"exit code {child.returncode}" + (f": {lines[-1]}" if lines else ""))
    gone = [p for p in outputs if not os.path.exists(os.path.join(root, p))]
    if gone:
        raise BlockError(f"output {gone[0]} wasn't made")
