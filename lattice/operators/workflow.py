"""Workflows of continuous integration as a chain: files declare jobs, jobs wait for jobs and contain steps, steps use actions and run commands,
commands invoke scripts of the tree.

A file's jobs and steps are read by indentation, its commands by a scanner that keeps quotes, continued lines and here-documents together, in
an Arrow function; what they mean across files is joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BATCH_ROWS, cut, python_ready
from .joins import small
from .walks import levels

COLUMNS = "rel string, kind string, job string, step int, name string, line int, value string, words array<string>, boundary string, script string, workflow string, typed string"
_KEY = re.compile(r"""^(\s*)(?:-\s+)?["']?([\w.-]+)["']?\s*:(?:\s+(.*?))?\s*$""")
#: Runs of characters that mean nothing but themselves, outside quotes and inside them.
_PLAIN, _QUOTED, _DOUBLY = (re.compile(p) for p in (r"""[^\s'"\\#;|&$`<>{}()]+""", r"[^'\n]+", r"""[^"\\\n$`]+"""))
_HEREDOC = re.compile(r"""<<(-?)\s*(?:'([^'\n]*)'|"([^"\n]*)"|([^\s;&|<>()]+))""")
_CONTROL = re.compile(r"^(?:if|then|else|elif|fi|for|while|until|do|done|case|esac|\{|\}|\(|\)|;;)\b|^[{}()]$")


def commands(script: str) -> list[tuple[int, str, list[str], str | None]]:
    """line (from 0), command, words and boundary of each command of a shell script.

    Lines that end with a backslash go on, and so do open quotes; a here-document belongs to its command (boundary ``heredoc``) and is not
    read. Commands end with the line, ``;``, ``&&``, ``||``, ``|`` or ``&``. Other boundaries: ``computed`` (the words depend on what runs) and ``control``
    (a word of a branch or loop). Comments and empty commands are none."""
    out: list[tuple[int, str, list[str], str | None]] = []
    words: list[str] = []
    word: str | None = None
    state = {"begin": 0, "start": 0, "computed": False, "heredoc": False}
    pending: list[tuple[str, bool]] = []
    i, line, n, quote = 0, 0, len(script), ""

    def close_word() -> None:
        nonlocal word
        if word is not None:
            words.append(word)
        word = None

    def close(end: int) -> None:
        close_word()
        if words:
            boundary = "heredoc" if state["heredoc"] else "control" if _CONTROL.match(words[0]) else "computed" if state["computed"] else None
            out.append((state["begin"], re.sub(r"\s*\\\n\s*", " ", script[state["start"] : end]).strip(), list(words), boundary))
        words.clear()
        state["computed"] = state["heredoc"] = False

    while i < n:
        c = script[i]
        if word is None and not words and not c.isspace():
            state["begin"], state["start"] = line, i
        run = (_QUOTED if quote == "'" else _DOUBLY if quote else _PLAIN).match(script, i)
        if run:
            word = (word or "") + run[0]
            i = run.end()
        elif quote:
            if c == "\\" and quote == '"' and i + 1 < n:
                word += script[i + 1]
                line += script[i + 1] == "\n"
                i += 2
                continue
            if c == quote:
                quote = ""
            else:
                if c == "$" and quote == '"' and script[i : i + 2] == "$(" or c == "`" and quote == '"':
                    state["computed"] = True
                word += c
            line += c == "\n"
            i += 1
        elif c == "\\":
            if script[i + 1 : i + 2] == "\n":
                close_word()
                line += 1
            elif i + 1 < n:
                word = (word or "") + script[i + 1]
            i += 2
        elif c in "'\"":
            quote, word = c, word or ""
            i += 1
        elif c == "#" and word is None:
            i = script.find("\n", i)
            i = n if i < 0 else i
        elif script.startswith("<<<", i):
            close_word()
            i += 3
        elif script.startswith("<<", i):
            m = _HEREDOC.match(script, i)
            close_word()
            if m:
                pending.append((m[2] or m[3] or m[4] or "", bool(m[1])))
                state["heredoc"] = True
            i = m.end() if m else i + 2
        elif c == "\n":
            close(i)
            line += 1
            i += 1
            while pending and i < n:
                mark, dashed = pending[0]
                end = script.find("\n", i)
                row = script[i : n if end < 0 else end]
                if (row.lstrip("\t") if dashed else row).rstrip("\r") == mark:
                    pending.pop(0)
                line += 1
                i = n if end < 0 else end + 1
        elif c in ";|&":
            if c == "&" and (script[i - 1 : i] == ">" or script[i + 1 : i + 2] == ">"):
                word = (word or "") + c
                i += 1
                continue
            close(i)
            i += 2 if script[i : i + 2] in ("&&", "||", ";;") else 1
        elif c.isspace():
            close_word()
            i += 1
        else:
            if script.startswith("$(", i) or c == "`" or (c == "$" and word is None and not words):
                state["computed"] = True
            word = (word or "") + c
            i += 1
    if quote or state["heredoc"] or word is not None or words:
        close(n)
    return out


#: Scripts up to this length are kept with what was read of them, as workflows repeat each other's.
_KEPT_CHARS = 2000
_INTERPRETERS = {"bash", "sh", "zsh", "node", "python", "python3", "source", ".", "bun", "deno", "ruby"}
_DOTTED = re.compile(r"\\|(?:^|/)\.{0,2}(?:/|$)")


def _named(words: list[str]) -> tuple[str | None, str | None, str | None]:
    """The file that a command may invoke, the workflow that it dispatches, and the script of a package or recipe that it means, as one would type it: yarn x,
    pnpm x and npm test mean npm run x; the tool's own words aren't scripts."""
    word, second, third, fourth = (*words[:4], None, None, None)[:4]
    script = next((w for w in words[1:101] if not w.startswith("-")), None) if word in _INTERPRETERS else word
    if script is not None and _DOTTED.search(script):
        parts: list[str] = []
        for x in script.replace("\\", "/").split("/"):
            if x == "..":
                del parts[-1:]
            elif x not in ("", "."):
                parts.append(x)
        script = "/".join(parts) or "."
    workflow = f".github/workflows/{fourth}" if fourth is not None and words[:3] == ["gh", "workflow", "run"] else None
    typed = None
    if word == "npm" and second in ("test", "start"):
        typed = f"npm run {second}"
    elif word in ("npm", "pnpm", "yarn", "bun") and second == "run":
        typed = None if third is None else f"npm run {third}"
    elif word in ("make", "just"):
        typed = word if second is None else f"{word} {second}"
    return script, workflow, typed


def _commands(script: str) -> tuple[tuple, ...]:
    """``commands`` with what they name; behind a boundary they name nothing."""
    return tuple((line, command, words, boundary, *(_named(words) if boundary is None else (None, None, None))) for line, command, words, boundary in commands(script))


def _block_commands(rows: str) -> tuple[tuple, ...]:
    """The commands of a block of rows, each after a line feed, without the indent that they share."""
    block = rows[1:].split("\n")
    left = min((len(x) - len(x.lstrip()) for x in block if x.strip()), default=0)
    return _commands("\n".join(x[left:] for x in block))


_kept_commands, _kept_block_commands = lru_cache(maxsize=4096)(_commands), lru_cache(maxsize=4096)(_block_commands)

_TOP = re.compile(r"(?m)^jobs:[^\S\n]*$")
#: Words, boundary, script, workflow and typed of what is no command.
_NOTHING = (None,) * 5
_BLOCK = re.compile(r"[|>][+-]?\d*$")
_NOTE = re.compile(r"\s+#.*$")


@lru_cache(maxsize=256)
def _deeper(depth: int) -> re.Pattern:
    """The rows, each after a line feed, that are blank or have a larger indent."""
    return re.compile(r"(?:\n(?: {%d}[^\n]*|[^\S\n]{%d}[^\n]*|[^\S\n]*(?=\n|\Z)))*" % (depth + 1, depth + 1))


def _scalar(value: str | None) -> str:
    value = (value or "").strip()
    if "#" in value:
        value = _NOTE.sub("", value).strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value


def _items(text: str, at: int, indent: int, value: str | None) -> list[str]:
    """A scalar, a list in brackets, or the items below; ``at`` is where the row ends."""
    value = _NOTE.sub("", (value or "").strip()).strip()
    if value.startswith("["):
        return [_scalar(x) for x in value.strip("[]").split(",") if _scalar(x)]
    if value:
        return [_scalar(value)]
    out = []
    while at < len(text):
        end = text.find("\n", at + 1)
        end = len(text) if end < 0 else end
        row, at = text[at + 1 : end], end
        if row.strip() and not (row.strip().startswith("- ") and len(row) - len(row.lstrip()) >= indent):
            break
        if row.strip():
            out.append(_scalar(row.strip()[2:]))
    return out


def read_workflow(text: str) -> list[tuple]:
    """kind, job, step, name, line, value, words, boundary and what a command names (script, workflow, typed) of a workflow's jobs, needs, steps, uses and
    commands. Empty where there are no jobs."""
    top = _TOP.search(text)
    if top is None:
        return []
    out: list[tuple] = []
    job = step = job_depth = steps_depth = None
    item_depth = place = 0
    # at: where the row before ends; line: the number of that row
    at, n = top.end(), len(text)
    line = text.count("\n", 0, at) + 1
    while at < n:
        begin = at + 1
        at = text.find("\n", begin)
        row = text[begin:] if at < 0 else text[begin:at]
        at = n if at < 0 else at
        line += 1
        bare = row.lstrip()
        if not bare or bare[0] == "#":
            continue
        depth = len(row) - len(bare)
        if not depth:
            break
        dashed = bare.startswith("- ")
        inner = bare[2:].lstrip() if dashed else bare
        key, colon, value = inner.partition(":")
        if not colon:
            key = None
        elif not key.isalnum():  # a key of other characters, in quotes or before spaces, or none
            m = _KEY.match(row)
            key, value = (m[2], m[3]) if m else (None, None)
        elif value and not value[0].isspace():
            key = None
        if job_depth is None:
            job_depth = depth
        if depth == job_depth and key is not None:
            job, step, steps_depth = key, None, None
            out.append(("job", job, None, job, line, None, *_NOTHING))
        elif job is None:
            continue
        elif steps_depth is None:
            if key == "needs":
                out += [("needs", job, None, job, line, x, *_NOTHING) for x in _items(text, at, depth, value)]
            elif key == "uses":
                out.append(("uses", job, None, job, line, _scalar(value), *_NOTHING))
            elif key == "steps":
                steps_depth = depth
        elif depth >= steps_depth:
            key_depth = depth
            if dashed:
                if step is None or depth <= item_depth:
                    step = 1 if step is None else step + 1
                    item_depth, place = depth, len(out)
                    out.append(("step", job, step, None, line, None, *_NOTHING))
                key_depth += len(bare) - len(inner)
            if step is None or key_depth <= item_depth:
                continue
            if key == "name":
                out[place] = (*out[place][:3], _scalar(value), *out[place][4:])
            elif key == "uses":
                out.append(("uses", job, step, None, line, _scalar(value), *_NOTHING))
            elif key == "run":
                value = (value or "").strip()
                if value == "|" or _BLOCK.match(value):
                    begin, at = at, _deeper(key_depth).match(text, at).end()
                    found = (_kept_block_commands if at - begin <= _KEPT_CHARS else _block_commands)(text[begin:at])
                    first, line = line + 1, line + text.count("\n", begin, at)
                else:
                    body, first = _scalar(value), line
                    found = _kept_commands(body) if len(body) <= _KEPT_CHARS else _commands(body)
                for after, command, *rest in found:
                    out.append(("command", job, step, None, first + after, command, *rest))
    return out


def workflow_facts(bodies: DataFrame) -> DataFrame:
    """The rows of ``read_workflow`` of bodies (rel, text), in COLUMNS; null texts and texts without jobs have none. A step has its name, or else null."""
    python_ready(bodies.sparkSession)
    return bodies.select("rel", "text").mapInArrow(read_batches, COLUMNS)


def read_batches(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """A batch of facts for each ``rows`` bodies at most and, within these, whenever a body has brought it to 64 x ``rows`` facts, so
    that a worker's memory doesn't grow with the batches it is given."""
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 4]

    def packed(rels, counts, facts):
        rel = pa.array(rels, pa.string()).take(pa.array(np.repeat(np.arange(len(rels)), counts)))
        return pa.RecordBatch.from_arrays([rel, *(pa.array(x, t) for x, t in zip(zip(*facts) if facts else [()] * len(types), types))], names=names)

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            rels, counts, facts = [], [], []
            for rel, text in zip(*(c.to_pylist() for c in batch.slice(at, rows).columns)):
                found = read_workflow(text or "")
                rels.append(rel)
                counts.append(len(found))
                facts += found
                if len(facts) >= 64 * rows:
                    yield packed(rels, counts, facts)
                    rels, counts, facts = [], [], []
            yield packed(rels, counts, facts)


def job_levels(facts: DataFrame) -> DataFrame:
    """scope (the file), node (the job) and level of each job: how many jobs must end before it, one after another; null on and behind cycles."""
    facts = cut(facts.filter("kind IN ('job', 'needs')").select("rel", "kind", "job", "value"))
    jobs = facts.filter("kind = 'job'").select(F.col("rel").alias("scope"), F.col("job").alias("node"))
    needs = facts.filter("kind = 'needs'").select(F.col("rel").alias("scope"), F.col("job").alias("node"), F.col("value").alias("needed"))
    return levels(jobs, needs)


def execution_edges(facts: DataFrame, files: DataFrame, scripts: DataFrame | None = None) -> DataFrame:
    """from, to, type, evidence, strength, path and line of the chain. files: rel of the tree's files; scripts: name (as one would type it) and rel of
    package scripts and recipes. A script is a word of a command that names a file of the tree, as the command itself or right after an interpreter; what lies
    behind a boundary is not followed."""
    job = F.concat(F.lit("job:"), "rel", F.lit("#"), "job")
    step = F.concat(F.lit("step:"), "rel", F.lit("#"), "job", F.lit("/"), F.lpad(F.col("step").cast("string"), 4, "0"))
    owner = F.when(F.col("step").isNull(), job).otherwise(step)

    kind, own = F.col("kind"), F.col("value").startswith("./")
    place = F.expr("rtrim('/', substring(value, 3))")
    followed = (kind == "command") & F.col("boundary").isNull()
    known = files.select("rel").distinct()
    places = known.select(F.explode(F.array_distinct(F.array("rel", F.regexp_replace("rel", "/[^/]*$", "")))).alias("place")).distinct()

    # each fact meets what it may name, and is read once
    rows = _met(facts, F.when((kind == "uses") & own, place), places.select(F.col("place").alias("__key"), F.lit(True).alias("__exists")), "__place")
    rows = _met(rows, F.col("script"), known.select(F.col("rel").alias("__key"), F.lit(True).alias("__invoked")), "__script")
    rows = _met(rows, F.col("workflow"), known.select(F.col("rel").alias("__key"), F.lit(True).alias("__dispatched")), "__other")

    # a fact has one edge by its kind (0); a command may invoke a script (1) and dispatch a workflow (2), and means scripts of the package (from 3)
    numbers = lambda *k: F.array(*[F.lit(x) for x in k])
    led = F.when(F.col("__invoked") & F.col("__dispatched"), numbers(0, 1, 2)).when(F.col("__invoked"), numbers(0, 1)).when(F.col("__dispatched"), numbers(0, 2)).otherwise(numbers(0))
    named = F.lit(None).cast("string")
    if scripts is not None:
        owners = scripts.groupBy(F.col("name").alias("__key")).agg(F.collect_set("rel").alias("__owners"))
        rows = _met(rows, F.col("typed"), owners, "__typed")
        led = F.when(F.size("__owners") > 0, F.concat(led, F.sequence(F.lit(3), F.size("__owners") + 2))).otherwise(led)
        named = F.concat(F.get("__owners", F.col("__edge") - 3), F.lit("#"), F.regexp_replace("__typed", "^npm run ", ""))
    rows = rows.withColumn("__edge", F.explode(F.when(followed, led).when(kind.isin("job", "needs", "step", "uses"), numbers(0))))

    # what an edge is stands in columns of its own, so that those that nobody asks for aren't computed
    at = F.col("__edge")
    first = lambda **by: F.when(kind == "job", by["job"]).when(kind == "needs", by["needs"]).when(kind == "step", by["step"]).when(kind == "uses", by["uses"]).otherwise(by["command"])
    of = lambda main, script, workflow, target: F.when(at == 0, main).when(at == 1, script).when(at == 2, workflow).otherwise(target)
    used = F.when(~own, "uses_external_action").when(F.col("__place").startswith(".github/workflows/"), "invokes_workflow").otherwise("invokes_action")
    strings = lambda **by: first(**{k: F.lit(v) if isinstance(v, str) else v for k, v in by.items()})
    return rows.select(
        first(job=F.col("rel"), needs=job, step=job, uses=owner, command=step).alias("from"),
        of(first(job=job, needs=F.concat(F.lit("job:"), "rel", F.lit("#"), "value"), step=step, uses=F.when(own, F.col("__place")).otherwise(F.concat(F.lit("action:"), "value")), command=F.col("value")), F.col("__script"), F.col("__other"), named).alias("to"),
        of(strings(job="declares_job", needs="needs_job", step="contains_step", uses=used, command="runs_command"), F.lit("invokes_script"), F.lit("dispatches_workflow"), F.lit("invokes_target")).alias("type"),
        F.when(at == 2, "workflow_dispatch").otherwise(strings(job="workflow_job", needs="workflow_needs", step="workflow_step", uses="workflow_uses", command="workflow_run")).alias("evidence"),
        F.when((kind != "uses") | ~own | F.col("__exists"), "hard").otherwise("medium").alias("strength"),
        F.col("rel").alias("path"),
        "line",
    )


def _met(rows: DataFrame, key, table: DataFrame, name: str) -> DataFrame:
    """rows with ``key`` as ``name`` and what ``table`` has of its __key, which is unique there; null where it has none. Null keys are dealt over
    tasks where the table is too large to be broadcast."""
    rows, sent = rows.withColumn(name, key), small(table)
    if sent is not table:
        return rows.join(sent.withColumnRenamed("__key", "__met"), F.col(name) == F.col("__met"), "left").drop("__met")
    nowhere = F.concat(F.lit("\0"), F.pmod(F.xxhash64("rel", "line"), F.lit(1000)).cast("string"))
    return rows.withColumn("__met", F.coalesce(name, nowhere)).join(table.withColumnRenamed("__key", "__met"), "__met", "left").drop("__met")


def execution_unknowns(facts: DataFrame) -> DataFrame:
    """kind, path and line of what the chain doesn't follow, once for each kind and step."""
    kind = F.when((F.col("kind") == "uses") & ~F.col("value").startswith("./"), "external_action_execution").when(F.col("boundary") == "heredoc", "heredoc_execution_boundary").when(F.col("boundary") == "computed", "computed_shell_execution").when(F.col("boundary") == "control", "shell_control_execution")
    rows = facts.withColumn("unknown", kind).filter("unknown IS NOT NULL")
    return rows.groupBy(F.col("unknown").alias("kind"), F.col("rel").alias("path"), "job", "step").agg(F.min("line").alias("line"))
