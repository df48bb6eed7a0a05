"""Untrusted programs in a child process, as an Arrow UDF.

The child is an isolated interpreter with limits on processor time, memory and file size. It loads a fixed set of modules, then installs an
audit hook that allows only what computing needs: everything else, opening any file included, raises. The program has to set `answer`.
"""

from __future__ import annotations

import json
import subprocess
import sys
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from .latest import seeded_sample

WALL_S, CPU_S, MEMORY_MB, THREADS = 5, 5, 512, 2
SCHEMA = "ok boolean, num double, text string, error string, timed_out boolean"
_MARK = "=>answer:"
_CHILD = r"""
import sys, json, math, cmath, decimal, fractions, statistics, itertools, functools, collections, operator, re, datetime, random, string, numbers
source, cpu, memory = sys.stdin.read(), int(sys.argv[1]), int(sys.argv[2])
try:
    import resource
    for kind, value in ((resource.RLIMIT_CPU, cpu), (resource.RLIMIT_AS, memory), (resource.RLIMIT_FSIZE, 0), (resource.RLIMIT_CORE, 0)):
        resource.setrlimit(kind, (value, value))
except (ImportError, ValueError, OSError):
    pass
allowed = frozenset(("compile", "exec", "import", "builtins.id", "code.__new__", "object.__getattr__", "object.__setattr__", "object.__delattr__", "sys.excepthook", "sys.unraisablehook", "array.__new__", "time.sleep"))
def hook(event, args, allowed=allowed, error=PermissionError):
    if event not in allowed:
        raise error("blocked: " + event)
write, dumps, scope = sys.stdout.write, json.dumps, {"__name__": "program"}
code = compile(source, "program", "exec")
sys.addaudithook(hook)
exec(code, scope)
if "answer" not in scope:
    raise NameError("the program sets no answer")
value = scope["answer"]
try:
    out = dumps(value)
except (TypeError, ValueError):
    out = dumps(repr(value))
write("\n" + MARK + out + "\n")
"""


def run_program(code: str | None, wall_s: float = WALL_S, cpu_s: int = CPU_S, memory_mb: int = MEMORY_MB) -> dict:
    """One program's result; never raises. Programs that don't mention `answer` aren't started."""
    out = {"ok": False, "num": None, "text": None, "error": "", "timed_out": False}
    if not code or "answer" not in code:
        return out | {"error": "the program sets no answer"}
    try:
        child = subprocess.run(
            [sys.executable, "-I", "-B", "-c", f"MARK = {_MARK!r}\n{_CHILD}", str(cpu_s), str(memory_mb << 20)],
            input=code.encode("utf-8", "replace"), capture_output=True, timeout=wall_s, env={},
        )
    except subprocess.TimeoutExpired:
        return out | {"error": "timed out", "timed_out": True}
    except (OSError, ValueError) as e:
        return out | {"error": str(e)}
    line = next((x for x in reversed(child.stdout.decode(errors="replace").splitlines()) if x.startswith(_MARK)), None)
    if child.returncode or line is None:
        last = child.stderr.decode(errors="replace").strip().splitlines()[-1:]
        return out | {"error": (last or [f"exit code {child.returncode}"])[0][:500], "timed_out": child.returncode == -24}
    value = json.loads(line[len(_MARK) :])
    if isinstance(value, bool) or value is None or not isinstance(value, (int, float, str)):
        return out | {"ok": True, "text": value if isinstance(value, str) else json.dumps(value) if not isinstance(value, bool) else str(value)}
    return out | ({"ok": True, "text": value} if isinstance(value, str) else {"ok": True, "num": float(value)})


def _run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    columns = ["ok", "num", "text", "error", "timed_out"]
    with ThreadPoolExecutor(THREADS) as pool:
        for s in batches:
            unique = list(s.dropna().unique())
            known = dict(zip(unique, pool.map(run_program, unique)))
            yield pd.DataFrame([known.get(x) or run_program(None) for x in s], columns=columns).astype({"num": "float64"})


def execute(program: Column) -> Column:
    """struct<ok, num, text, error, timed_out> of a program. Equal programs of a batch run once. Repartition before it where programs are few and slow."""
    return F.pandas_udf(_run, SCHEMA)(program)


def spot_check(records: DataFrame, n: int = 50, seed: int = 0, uid: str = "uid") -> DataFrame:
    """Of n sampled records with a program (gold_program, answer), how many programs give the gold answer in the sandbox: checked, agreed."""
    some = seeded_sample(records.where("gold_program is not null").select(uid, "gold_program", "answer"), n, uid, seed)
    ran = some.withColumn("_r", execute(F.col("gold_program")))
    agrees = F.col("_r.ok") & N.answers_match(N.of("_r"), N.of("answer"))
    return ran.agg(F.count("*").alias("checked"), F.count_if(agrees).alias("agreed"))


def verify(records: DataFrame) -> DataFrame:
    """The records whose program gives their answer in the sandbox, by the strict rule. Records without a program never start one."""
    ran = records.where("gold_program is not null").withColumn("_r", execute(F.col("gold_program")))
    return ran.where(F.col("_r.ok") & N.answers_match(N.of("_r"), N.of("answer"))).drop("_r")
