"""Structured extractions: prompts, answers of a model, their repair and decoding, and the tables that come of them."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions import text

from . import resolve

#: Fields of an answer, in order, and event types (fixed values).
FIELDS = ("source", "targets", "event_type")
EVENT_TYPES = ("", "other", "earnings", "guidance", "merger_acquisition", "lawsuit", "product_launch", "regulatory", "partnership", "investment", "bankruptcy", "macro", "geopolitical")
#: Keywords an answer's schema must not use (fixed values).
FORBIDDEN = ("anyOf", "oneOf", "allOf", "nullable")
MOCK_TARGETS, MOCK_EVENTS = ("Apple", "Microsoft", "NVIDIA", "Amazon"), ("partnership", "other", "product_launch")
DECODED = "source string, targets array<string>, event_type string, error_type string, error_message string, repaired string"
#: Columns of the tables of a run, in order (fixed values).
_HEAD = "news_id string, shard_id string, batch_id long, published_date string, cutoff_date string, "
_SOURCE = "source_ticker string, source_company_name string, request_mode string, "
RAW = _HEAD + _SOURCE + "raw_content string, repaired_content string, response_repaired boolean, raw_content_sha256 string, status string, error_type string, error_message string, seed long, run_mode string, processed_at_utc string"
PARSED = _HEAD + "is_warmup boolean, in_evaluation_window boolean, " + _SOURCE + (
    "extracted_source string, extracted_targets array<string>, extracted_event_type string, is_valid_source boolean, has_valid_targets boolean, valid_target_count long, "
    "resolved_target_tickers array<string>, unresolved_targets array<string>, resolved_target_count long, has_resolved_targets boolean, self_loop_targets_dropped long, "
    "target_resolution_json string, raw_content_sha256 string, seed long, run_mode string"
)
FAILURES = _HEAD + _SOURCE + "raw_content_sha256 string, error_type string, error_message string, seed long, run_mode string"


class DecodeError(ValueError):
    """An answer that is not the object asked for."""


class SchemaError(ValueError):
    """A schema that the server could not enforce."""


class ClientError(RuntimeError):
    """The server gave no usable answer."""


def answer_schema(event_types: tuple[str, ...] = EVENT_TYPES) -> dict:
    kinds = {"source": {"type": "string"}, "targets": {"type": "array", "items": {"type": "string"}}, "event_type": {"type": "string", "enum": list(event_types)}}
    return {"type": "object", "additionalProperties": False, "properties": {f: kinds[f] for f in FIELDS}, "required": list(FIELDS)}


def schema_errors(schema: dict) -> list[str]:
    """What keeps a schema from being enforced; nothing if it is fine."""
    found = []
    todo: list[tuple[str, object]] = [("", schema)]
    while todo:
        at, node = todo.pop()
        pairs = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ()
        for key, value in pairs:
            here = f"{at}/{key}"
            if isinstance(node, dict) and (key in FORBIDDEN or (key == "type" and value == "null")):
                found.append(f"{here} is not allowed")
            todo.append((here, value))
    kinds = schema.get("properties") if isinstance(schema.get("properties"), dict) else {}
    event = kinds.get("event_type") if isinstance(kinds.get("event_type"), dict) else {}
    values = event.get("enum")
    wanted = [
        (schema.get("type") == "object", "it must describe an object"),
        (schema.get("additionalProperties") is False, "it must forbid further properties"),
        (tuple(kinds) == FIELDS, f"its properties must be {list(FIELDS)}, in order"),
        (schema.get("required") == list(FIELDS), f"it must require {list(FIELDS)}"),
        (isinstance(kinds.get("source"), dict) and kinds["source"].get("type") == "string", "source must be a string"),
        (event.get("type") == "string" and isinstance(values, list) and bool(values) and all(isinstance(v, str) for v in values), "event_type must be a string of a list of values"),
        (isinstance(kinds.get("targets"), dict) and kinds["targets"].get("type") == "array" and (kinds["targets"].get("items") or {}).get("type") == "string", "targets must be an array of strings"),
    ]
    return sorted(found) + [why for ok, why in wanted if not ok]


def checked_schema(schema: dict) -> dict:
    if errors := schema_errors(schema):
        raise SchemaError("; ".join(errors))
    return schema


def with_prompt(news: DataFrame, event_types: tuple[str, ...] = EVENT_TYPES, max_chars: int = 4000) -> DataFrame:
    """Adds prompt, an array of (role, content) that asks for one answer about the row's article."""
    system = (
        "Read one financial news article and report its main event as one JSON object, without any text around it. "
        "The object has three keys: source, the company the event is about, or an empty string; targets, the companies the article "
        "itself names as affected, or an empty list; event_type, one of the allowed values. Do not add companies that the article does not name "
        "as affected. Use other for an event of no listed kind, and an empty event_type if there is no telling."
    )
    hint = F.coalesce(text.optional("source_company_name"), text.optional("source_ticker"), F.lit("unknown"))
    user = F.concat(F.lit("Date: "), text.or_empty("published_date"), F.lit("\nPossible source, to be checked against the article: "), hint, F.lit(f"\nEvent types: {', '.join(repr(e) for e in event_types)}\n\n"), text.article(max_chars))
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return news.withColumn("prompt", F.array(one("system", F.lit(system)), one("user", user)))


#: What a search for braces must see: strings, the last of which may be open, escaped characters, and braces.
PIECES = re.compile(r'"(?:[^"\\]|\\.)*"?|\\.|[{}]', re.DOTALL)
FENCE = re.compile(r"```[^\n]*\n(.*)\n[^\n]*```", re.DOTALL)


def repaired(answer: str | None) -> str:
    """The answer without a code fence of three lines or more, from the first brace outside a string to its partner; if there is no such
    object, the stripped text."""
    body = (answer or "").strip()
    if fence := FENCE.fullmatch(body):
        body = fence[1].strip()
    braces = [(m.start(), m[0]) for m in PIECES.finditer(body) if m[0] in ("{", "}")]
    first = next((k for k, (_, brace) in enumerate(braces) if brace == "{"), len(braces))
    open_after = accumulate(1 if brace == "{" else -1 for _, brace in braces[first:])
    end = next((at + 1 for (at, _), still in zip(braces[first:], open_after, strict=True) if not still), None)
    return body if end is None else body[braces[first][0] : end]


def decode(answer: str) -> dict:
    """source, targets and event_type of an answer; blanks become None, targets are stripped and each kept once."""
    body = (answer or "").strip()
    if not body:
        raise DecodeError("the answer is empty")
    try:
        found = json.loads(body)
    except ValueError as e:
        raise DecodeError(f"the answer is no JSON: {e}") from e
    if not isinstance(found, dict):
        raise DecodeError("the answer is no object")
    if extra := sorted(set(found) - set(FIELDS)):
        raise DecodeError(f"unknown fields {extra}")
    plain = lambda x: None if x is None else str(x).strip() or None
    targets = found.get("targets")
    if targets is None or isinstance(targets, str):
        targets = [targets]
    if not isinstance(targets, list):
        raise DecodeError(f"targets is of type {type(targets).__name__}")
    return {"source": plain(found.get("source")), "targets": list(dict.fromkeys(t for x in targets if (t := plain(x)))), "event_type": plain(found.get("event_type"))}


def with_decoded(frame: DataFrame, column: str = "raw_content", repair: bool = True) -> DataFrame:
    """Adds decoded: the fields of each answer, or the kind of error and its message. JSON is read as Python reads it, so this is an
    Arrow function."""

    @F.pandas_udf(DECODED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for answers in batches:
            rows = []
            for a in answers:
                body = repaired(a) if repair else a or ""
                try:
                    rows.append((*decode(body).values(), None, None, body))
                except DecodeError as e:
                    rows.append((None, None, None, "StructuredDecodeError", str(e), ""))
            yield pd.DataFrame(rows, columns=["source", "targets", "event_type", "error_type", "error_message", "repaired"])

    return frame.withColumn("decoded", run(F.col(column)))


class Client:
    """What with_answers() asks: an object that can be sent to tasks."""

    request_mode = ""

    def answer(self, messages: list[dict], schema: dict, seed: int | None) -> str:
        raise NotImplementedError

    def asked(self, messages: list[dict], schema: dict, seed: int | None) -> tuple[str, str]:
        """The answer, and the way in which it was asked for."""
        return self.answer(messages, schema, seed), self.request_mode

    def preflight(self, schema: dict | None = None) -> dict:
        """Whether a run may begin: facts, among them ready."""
        return {"ready": True, "error": None}


class EmptyClient(Client):
    """Always the answer that nothing was found."""

    request_mode = "mock"

    def answer(self, messages: list[dict], schema: dict, seed: int | None) -> str:
        return json.dumps({"source": "", "targets": [], "event_type": ""})


#: What a request says of the wanted schema, by mode (the interface's field names).
WANTED: dict[str, Callable[[dict], dict]] = {
    "structured_outputs": lambda schema: {"response_format": {"type": "json_schema", "json_schema": {"name": "event", "schema": schema, "strict": True}}},
    "guided_json": lambda schema: {"response_format": {"type": "json_object"}, "guided_json": schema},
}
PROBE = [{"role": "user", "content": 'Answer {"source": "", "targets": [], "event_type": "other"}.'}]


@dataclass
class HttpClient(Client):
    """A server with the usual chat-completions interface. mode auto tries the modes of WANTED in turn."""

    base_url: str
    model: str
    api_key: str = "-"
    mode: str = "auto"
    settings: dict = field(default_factory=lambda: {"temperature": 0.0, "top_p": 1.0, "max_tokens": 512})
    timeout: float = 120.0
    send: Callable[[str, dict | None], dict] | None = None

    @property
    def modes(self) -> list[str]:
        return list(WANTED) if self.mode == "auto" else [self.mode]

    def payload(self, messages: list[dict], schema: dict, seed: int | None, mode: str) -> dict:
        if mode not in WANTED:
            raise ValueError(f"unknown request mode {mode!r}")
        return {"model": self.model, "messages": messages, **self.settings, **({} if seed is None else {"seed": seed}), **WANTED[mode](schema)}

    def _exchange(self, what: str, body: dict | None = None) -> dict:
        """A JSON answer to a GET, or to a POST of body."""
        url = re.sub(r"(/v1)?/*$", "/v1/", self.base_url, count=1) + what
        if self.send is not None:
            return self.send(url, body)
        headers = {"Authorization": f"Bearer {self.api_key}", "Content-Type": "application/json"}
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body and json.dumps(body).encode(), headers), timeout=self.timeout) as response:
                return json.load(response)
        except (urllib.error.URLError, OSError, ValueError) as e:
            raise ClientError(f"{what}: {e}") from e

    def asked(self, messages: list[dict], schema: dict, seed: int | None) -> tuple[str, str]:
        refusals = {}
        for mode in self.modes:
            request = self.payload(messages, schema, seed, mode)
            try:
                return _content(self._exchange("chat/completions", request)), mode
            except NoContent:
                raise
            except ClientError as e:
                refusals[mode] = e
        raise ClientError("; ".join(f"{mode}: {e}" for mode, e in refusals.items()))

    def answer(self, messages: list[dict], schema: dict, seed: int | None) -> str:
        return self.asked(messages, schema, seed)[0]

    def preflight(self, schema: dict | None = None) -> dict:
        """Whether the server can be reached, serves the model and, if a schema is given, answers one small request by it."""
        facts: dict = {"server_reachable": False, "model_resolved": False, "hosted_models": [], "structured_output": None, "error": None}
        try:
            hosted = [str(m["id"]) for m in self._exchange("models").get("data", []) if m.get("id")]
            facts |= {"server_reachable": True, "hosted_models": hosted, "model_resolved": self.model in hosted}
            if not facts["model_resolved"]:
                facts["error"] = f"{self.model} is not served"
            elif schema is not None:
                facts["structured_output"] = False
                decode(repaired(self.answer(PROBE, schema, 0)))
                facts["structured_output"] = True
        except (ClientError, DecodeError) as e:
            facts["error"] = str(e)
        return facts | {"ready": facts["error"] is None}


class NoContent(ClientError):
    """The server answered, but not with a text: asking in another mode is of no use."""


def _content(body: dict) -> str:
    """The text of the first choice; parts are joined."""
    try:
        found = body["choices"][0].get("message", {}).get("content", "")
    except (KeyError, IndexError) as e:
        raise NoContent("the server made no choice") from e
    parts = [p.get("text", "") for p in found if isinstance(p, dict)] if isinstance(found, list) else [found]
    if not all(isinstance(p, str) for p in parts):
        raise NoContent(f"content of type {type(found).__name__}")
    return "".join(parts)


def with_answers(rows: DataFrame, client: Client, schema: dict) -> DataFrame:
    """Adds raw_content, request_mode, client_error and client_message to rows with prompt and row_seed. One row's failure is that row's; each partition has a
    client of its own and rows are answered in batches as they come."""
    names = rows.columns

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for prompt, seed in zip(frame["prompt"], frame["row_seed"], strict=True):
                try:
                    out.append((*client.asked([dict(m) if isinstance(m, dict) else m.asDict() for m in prompt], schema, int(seed)), None, None))
                except Exception as e:  # whatever goes wrong with a row is recorded with it
                    out.append((None, None, type(e).__name__, str(e)))
            yield pd.concat([frame[names].reset_index(drop=True), pd.DataFrame(out, columns=["raw_content", "request_mode", "client_error", "client_message"], dtype=object)], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(ask, f"{fields}, raw_content string, request_mode string, client_error string, client_message string")


def with_mock_answers(rows: DataFrame, targets: tuple[str, ...] = MOCK_TARGETS, events: tuple[str, ...] = MOCK_EVENTS, failing: list[str] | None = None) -> DataFrame:
    """As with_answers(), from the row's seed alone and without leaving the JVM: two targets next to one another and an event type. Rows whose
    news_id is in failing fail."""
    pick = lambda values, shift=0: F.element_at(F.array(*map(F.lit, values)), ((F.col("row_seed") + shift) % len(values) + 1).cast("int"))
    source = F.coalesce(text.optional("source_company_name"), text.optional("source_ticker"), F.lit(""))
    body = F.to_json(F.struct(source.alias("source"), F.array_distinct(F.array(pick(targets), pick(targets, 1))).alias("targets"), pick(events).alias("event_type")))
    fails = F.coalesce(F.col("news_id").isin(failing), F.lit(False)) if failing else F.lit(False)
    return rows.withColumns({"raw_content": F.when(~fails, body), "request_mode": F.when(~fails, "mock"), "client_error": F.when(fails, "ClientError"), "client_message": F.when(fails, F.concat(F.lit("mock failure of "), F.col("news_id")))})


class Extraction(NamedTuple):
    raw: DataFrame
    parsed: DataFrame
    failures: DataFrame


@dataclass(frozen=True)
class ExtractConfig:
    run_mode: str = "mock"
    repair: bool = True
    resolver: resolve.ResolverConfig = field(default_factory=resolve.ResolverConfig)


def extraction(answered: DataFrame, aliases: DataFrame, config: ExtractConfig | None = None) -> DataFrame:
    """One row for each answered row with all columns of the tables of split(), which are selections of it: store it before splitting. A row's
    cutoff is its own date; flags that the news lack are false."""
    config = config or ExtractConfig()
    rows = with_decoded(answered, repair=config.repair)
    has = lambda c, kind: F.col(c).cast(kind) if c in answered.columns else F.lit(None).cast(kind)
    error, body = F.coalesce("client_error", "decoded.error_type"), text.or_empty("raw_content")
    good = error.isNull()
    rows = rows.withColumns(
        {
            "run_mode": F.lit(config.run_mode),
            "request_mode": text.or_empty("request_mode"),
            "raw_content": body,
            "raw_content_sha256": F.when(body == "", "").otherwise(text.digest(body)),
            "repaired_content": F.when(good, F.col("decoded.repaired")).otherwise(""),
            "response_repaired": good & (F.col("decoded.repaired") != text.strip(body)),
            "error_type": F.coalesce(error, F.lit("")),
            "error_message": F.coalesce("client_message", "decoded.error_message", F.lit("")),
            "status": F.when(good, "success").otherwise("failed"),
            "extracted_source": F.col("decoded.source"),
            "extracted_targets": F.coalesce("decoded.targets", F.array().cast("array<string>")),
            "extracted_event_type": F.col("decoded.event_type"),
            "cutoff_date": F.col("published_date"),
            "seed": F.col("row_seed"),
            "source_ticker": text.strip(text.or_empty("source_ticker")),
            "source_company_name": F.coalesce(text.strip(has("source_company_name", "string")), F.lit("")),
            "is_warmup": F.coalesce(has("is_warmup", "boolean"), F.lit(False)),
            "in_evaluation_window": F.coalesce(has("in_evaluation_window", "boolean"), F.lit(False)),
            "processed_at_utc": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"),
        }
    ).drop("decoded", "client_error", "client_message")
    out = resolve.resolved_lists(rows, aliases, config.resolver)
    n, m = F.size("extracted_targets"), F.size("resolved_target_tickers")
    return out.withColumns({"is_valid_source": F.col("extracted_source").isNotNull(), "has_valid_targets": n > 0, "valid_target_count": n.cast("long"), "resolved_target_count": m.cast("long"), "has_resolved_targets": m > 0})


def shaped(rows: DataFrame, columns: str) -> DataFrame:
    """rows with exactly these columns and types, in order; a missing one is an error."""
    return rows.select(*[F.col(name).cast(kind).alias(name) for name, kind in (c.split(" ") for c in columns.split(", "))])


def split(rows: DataFrame) -> Extraction:
    """Raw answers of all rows, parsed rows of the successful ones, and failures, with the columns of RAW, PARSED and FAILURES."""
    return Extraction(shaped(rows, RAW), shaped(rows.where("status = 'success'"), PARSED), shaped(rows.where("status = 'failed'"), FAILURES))
