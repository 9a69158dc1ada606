"""JSON services as a Spark data source: one payload a row, in batch by path and as a stream by time.

``spark.read.format("json_api").option("url", ...).option("paths", "clients,devices,networks,events").load()`` reads each
path in a task of its own. The stream asks for the time since the last batch, in slices of ``slice`` seconds, one
task each; a lost task asks for its slice again. A failed request fails the task, so Spark retries it.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

DEFAULTS = {"paths": "queries", "items": "queries,data", "auth": "none", "token_param": "auth", "login_path": "auth", "session_header": "sid", "since_param": "from", "until_param": "until", "time_field": "time", "slice": "3600", "lag": "5", "timeout": "30"}


class Part(InputPartition):
    def __init__(self, path: str, since: float | None = None, until: float | None = None):
        self.path, self.since, self.until = path, since, until


class Api:
    """One service: its options, and requests to it. ``auth`` is none, token or password; an empty password needs no login."""

    def __init__(self, options: dict):
        self.options = DEFAULTS | {k.lower(): v for k, v in options.items()}
        if "url" not in self.options:
            raise ValueError("json_api needs the option url")
        if self.options["auth"] not in ("none", "token", "password"):
            raise ValueError(f"auth is none, token or password, not {self.options['auth']!r}")

    def paths(self) -> list[str]:
        return [p.strip() for p in self.options["paths"].split(",") if p.strip()]

    def _ask(self, path: str, params: dict, headers: dict, body: dict | None = None):
        query = f"?{urlencode(params)}" if params else ""
        data = None if body is None else json.dumps(body).encode()
        request = Request(f"{self.options['url'].rstrip('/')}/{path.lstrip('/')}{query}", data, {"Content-Type": "application/json", **headers})
        with urlopen(request, timeout=float(self.options["timeout"])) as answer:
            return json.load(answer)

    def items(self, part: Part) -> Iterator[tuple[str, str]]:
        """(path, payload) of the rows of one part; a row without a numeric time belongs to the part that got it."""
        o, params, headers = self.options, {}, {}
        if "length" in o:
            params["length"] = o["length"]
        if o["auth"] == "token":
            params[o["token_param"]] = o["token"]
        elif o["auth"] == "password" and o.get("password"):
            said = self._ask(o["login_path"], {}, {}, {"password": o["password"]})
            headers[o["session_header"]] = str(said.get("session", said)["sid"])
        if part.since is not None:
            params |= {o["since_param"]: part.since, o["until_param"]: part.until}
        body = self._ask(part.path, params, headers)
        lists = [body] if isinstance(body, list) else [body[k] for k in o["items"].split(",") if isinstance(body.get(k), list)]
        for row in lists[0] if lists else []:
            at = row.get(o["time_field"]) if isinstance(row, dict) else None
            if part.since is None or not isinstance(at, (int, float)) or part.since <= at < part.until:
                yield part.path, json.dumps(row)


class ApiReader(DataSourceReader):
    def __init__(self, options: dict):
        self.api = Api(options)

    def partitions(self) -> list[Part]:
        return [Part(p) for p in self.api.paths()]

    def read(self, partition: Part) -> Iterator[tuple[str, str]]:
        return self.api.items(partition)


class ApiStream(DataSourceStreamReader):
    """Offsets are times: ``since`` (default: the start of the stream) up to ``lag`` seconds ago, so late rows still count."""

    def __init__(self, options: dict):
        self.api = Api(options)

    def initialOffset(self) -> dict:
        return {"until": float(self.api.options.get("since", time.time()))}

    def latestOffset(self) -> dict:
        return {"until": time.time() - float(self.api.options["lag"])}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        first, last, step = start["until"], end["until"], float(self.api.options["slice"])
        cuts = [first]
        while cuts[-1] < last:
            cuts.append(min(last, cuts[-1] + step))
        return [Part(p, a, b) for p in self.api.paths() for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: Part) -> Iterator[tuple[str, str]]:
        return self.api.items(partition)


class JsonApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_api"

    def schema(self) -> str:
        return "path string, payload string"

    def reader(self, schema) -> ApiReader:
        return ApiReader(dict(self.options))

    def streamReader(self, schema) -> ApiStream:
        return ApiStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonApi)
