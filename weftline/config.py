"""Settings of a crawl, credentials and headers of requests, .env files, logs."""

from __future__ import annotations

import base64
import hashlib
import json
import logging
import logging.handlers
import os
import re
from dataclasses import asdict, dataclass, field, fields, replace
from datetime import datetime, timezone

_TRUE, _FALSE = {"true", "yes", "1", "on", "enabled"}, {"false", "no", "0", "off", "disabled", ""}


@dataclass
class Fetch:
    user_agent: str = "weftline/1"
    timeout: int = 10
    max_retries: int = 3
    max_response_bytes: int | None = None
    headers: dict[str, str] = field(default_factory=dict)


@dataclass
class Rate:
    delay: float = 0.1
    dynamic: bool = False
    max_delay: float = 60.0


@dataclass
class Output:
    """Where and how results are written: kind is json, csv, txt or html."""

    folder: str = "crawl_results"
    kind: str = "json"
    pretty: bool = True

    def __post_init__(self):
        if self.kind.lower() not in ("json", "csv", "txt", "html"):
            raise ValueError(f"unknown kind of output: {self.kind}")


@dataclass
class Crawl:
    max_depth: int = 3
    internal_only: bool = True
    same_path_only: bool = False
    respect_robots: bool = True
    max_queue: int | None = None
    fetch: Fetch = field(default_factory=Fetch)
    rate: Rate = field(default_factory=Rate)
    output: Output = field(default_factory=Output)

    def __post_init__(self):
        if self.max_depth < 0 or self.rate.delay < 0 or self.fetch.timeout <= 0:
            raise ValueError("max_depth and delay must not be negative, timeout must be positive")

    def snapshot(self) -> dict:
        return asdict(self)

    def with_changes(self, **changes) -> "Crawl":
        """A copy with the named settings changed, those of the parts as fetch_timeout, rate_delay or output_kind. ValueError for names that there aren't."""
        own = {f.name for f in fields(self)}
        parts = {n: {} for n in ("fetch", "rate", "output")}
        top = {}
        for k, v in changes.items():
            head, _, tail = k.partition("_")
            if k in own:
                top[k] = v
            elif head in parts and tail in {f.name for f in fields(getattr(self, head))}:
                parts[head][tail] = v
            else:
                raise ValueError(f"unknown setting: {k}")
        return replace(self, **top, **{n: replace(getattr(self, n), **p) for n, p in parts.items() if p})


@dataclass
class Auth:
    """kind: basic, bearer, digest (answered to a challenge), api_key (in a header or the query) or custom."""

    kind: str
    user: str | None = None
    password: str | None = None
    token: str | None = None
    name: str = "X-API-Key"
    place: str = "header"
    headers: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        need = {"basic": (self.user, self.password), "digest": (self.user, self.password), "bearer": (self.token,), "api_key": (self.token,), "custom": (self.headers,)}.get(self.kind)
        if need is None or not all(need):
            raise ValueError(f"incomplete or unknown credentials: {self.kind}")

    def request_headers(self) -> dict[str, str]:
        if self.kind == "basic":
            return {"Authorization": "Basic " + base64.b64encode(f"{self.user}:{self.password}".encode()).decode()}
        if self.kind == "bearer":
            return {"Authorization": f"Bearer {self.token}"}
        if self.kind == "digest":
            return {}
        if self.kind == "api_key":
            return {self.name: self.token} if self.place == "header" else {}
        return dict(self.headers)

    def request_params(self) -> dict[str, str]:
        return {self.name: self.token} if self.kind == "api_key" and self.place == "query" else {}


    def pair(self) -> tuple[str, str] | None:
        """User and password, where the kind has them."""
        return (self.user, self.password) if self.kind in ("basic", "digest") else None

    def answer(self, challenge: str, method: str, uri: str, cnonce: str, count: int = 1) -> dict[str, str]:
        """The header that answers a digest challenge (WWW-Authenticate), by RFC 7616 with MD5 or SHA-256 and qop auth or none."""
        given = dict(re.findall(r'(\w+)="?([^",]+)"?', challenge.partition(" ")[2]))
        name = given.get("algorithm", "MD5")
        h = lambda s: hashlib.new("sha256" if name.upper() == "SHA-256" else "md5", s.encode()).hexdigest()
        realm, nonce = given.get("realm", ""), given.get("nonce", "")
        a1, a2 = h(f"{self.user}:{realm}:{self.password}"), h(f"{method}:{uri}")
        qop = "auth" if "auth" in [q.strip() for q in given.get("qop", "").split(",")] else None
        nc = f"{count:08x}"
        response = h(f"{a1}:{nonce}:{nc}:{cnonce}:{qop}:{a2}") if qop else h(f"{a1}:{nonce}:{a2}")
        parts = [f'username="{self.user}"', f'realm="{realm}"', f'nonce="{nonce}"', f'uri="{uri}"', f'response="{response}"', f"algorithm={name}"]
        parts += [f'opaque="{given["opaque"]}"'] if "opaque" in given else []
        parts += [f"qop={qop}", f"nc={nc}", f'cnonce="{cnonce}"'] if qop else []
        return {"Authorization": "Digest " + ", ".join(parts)}


@dataclass
class Session:
    """What all requests of a crawl send; a later kind of header overwrites an earlier one of its name."""

    user_agent: str = "weftline/1"
    headers: dict[str, str] = field(default_factory=dict)
    token: str | None = None
    api_key: str | None = None
    api_key_name: str = "X-API-Key"

    def request_headers(self) -> dict[str, str]:
        own = {"User-Agent": self.user_agent, "Accept": "text/html,application/xhtml+xml,*/*;q=0.8"} | self.headers
        own |= {"Authorization": f"Bearer {self.token}"} if self.token else {}
        return own | ({self.api_key_name: self.api_key} if self.api_key else {})


def setting(name: str, kind: type = str, default=None, env: dict | None = None, dotenv: dict | None = None, file: dict | None = None):
    """A setting by its name: from the environment, else the .env file, else a settings file (names with dots go into it), else the default."""
    env = os.environ if env is None else env
    for source in (env, dotenv or {}):
        if name in source:
            return cast(source[name], kind, default) if kind is not str else source[name]
    at = file or {}
    for part in name.split("."):
        if not isinstance(at, dict) or part not in at:
            return default
        at = at[part]
    return at if isinstance(at, kind) else cast(str(at), kind, default)


class JsonLines(logging.Formatter):
    """A log record as a line of JSON, with what the record was given besides; spark.read.json reads the file."""

    _OWN = set(vars(logging.makeLogRecord({}))) | {"message", "asctime"}

    def format(self, record: logging.LogRecord) -> str:
        row = {"ts": datetime.fromtimestamp(record.created, timezone.utc).isoformat(), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        row |= {k: v for k, v in vars(record).items() if k not in self._OWN}
        if record.exc_info:
            row["error"] = self.formatException(record.exc_info)
        return json.dumps(row, ensure_ascii=False, default=str)


def configure_logging(level: str = "INFO", file: str | None = None, as_json: bool = False, max_bytes: int = 10 << 20, backups: int = 5, when: str | None = None, levels: dict[str, str] | None = None) -> logging.Logger:
    """Logs of this package to the console, and to a file that is cut by size or, if `when` is given (midnight, H, ...), by time. levels: of single modules."""
    log = logging.getLogger("weftline")
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    form = JsonLines() if as_json else logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
    found: list[logging.Handler] = [logging.StreamHandler()]
    if file:
        found.append(logging.handlers.TimedRotatingFileHandler(file, when=when, backupCount=backups) if when else logging.handlers.RotatingFileHandler(file, maxBytes=max_bytes, backupCount=backups))
    for h in found:
        h.setFormatter(form)
        log.addHandler(h)
    log.setLevel(level.upper())
    for name, own in (levels or {}).items():
        logging.getLogger(f"weftline.{name}").setLevel(own.upper())
    return log


def parse_env(text: str) -> dict[str, str]:
    """NAME=value lines; comments and blank lines don't count, one pair of quotes goes."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        k, v = (x.strip() for x in line.split("=", 1))
        out[k] = v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v
    return out


def cast(value: str | None, kind: type, default=None):
    """A setting as int, float, bool or list; the default where it is missing or isn't one."""
    if value is None:
        return default
    if kind is bool:
        low = value.strip().lower()
        return True if low in _TRUE else False if low in _FALSE else default
    if kind is list:
        return [x.strip() for x in value.split(",") if x.strip()]
    try:
        return kind(value)
    except ValueError:
        return default
