"""A small HTTP client for executors: retries of transport errors, none of refusals."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable
from typing import Any

#: (url, body, headers, timeout) to bytes; replaced in tests.
Transport = Callable[[str, bytes | None, dict[str, str], float], bytes]


def _open(url: str, body: bytes | None, headers: dict[str, str], timeout: float) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as r:
        return r.read()


class HttpClient:
    def __init__(self, transport: Transport = _open, attempts: int = 4, timeout: float = 30.0, wait: float = 1.0):
        self.transport, self.attempts, self.timeout, self.wait = transport, attempts, timeout, wait

    def _send(self, url: str, params: dict | None, body: bytes | None, headers: dict[str, str]) -> bytes:
        url += "?" + urllib.parse.urlencode(params) if params else ""
        for k in range(self.attempts):
            try:
                return self.transport(url, body, {"User-Agent": "tessera/1", **headers}, self.timeout)
            except urllib.error.HTTPError:
                raise
            except (OSError, TimeoutError):
                if k + 1 == self.attempts:
                    raise
                time.sleep(min(self.wait * 2**k, 30.0))
        raise AssertionError

    def get_bytes(self, url: str, params: dict | None = None, headers: dict[str, str] | None = None) -> bytes:
        return self._send(url, params, None, headers or {})

    def get_text(self, url: str, **options: Any) -> str:
        return self.get_bytes(url, **options).decode("utf-8", "replace")

    def get_json(self, url: str, **options: Any) -> Any:
        return json.loads(self.get_bytes(url, **options))

    def post(self, url: str, data: Any, params: dict | None = None, headers: dict[str, str] | None = None) -> bytes:
        return self._send(url, params, json.dumps(data).encode(), {"Content-Type": "application/json", **(headers or {})})

    def post_file(self, url: str, field: str, data: bytes) -> bytes:
        """One file as a form."""
        mark = uuid.uuid4().hex
        head = f'--{mark}\r\nContent-Disposition: form-data; name="{field}"; filename="{field}"\r\nContent-Type: application/octet-stream\r\n\r\n'
        return self._send(url, None, head.encode() + data + f"\r\n--{mark}--\r\n".encode(), {"Content-Type": f"multipart/form-data; boundary={mark}"})

    def alive(self, url: str) -> bool:
        """Whether a service answers at all."""
        try:
            self.get_bytes(url)
        except urllib.error.HTTPError:
            return False
        except OSError:
            return False
        return True
