"""A client for typing databases behind OAuth 1.0a (HMAC-SHA1). Credentials come from the caller; none are kept here."""

from __future__ import annotations

import base64
import hashlib
import hmac
import secrets
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from urllib.parse import parse_qsl, quote, urlencode, urlsplit

Send = Callable[[str, str, Mapping[str, str]], str]


def _quoted(x: str) -> str:
    return quote(x, safe="-._~")


def signature(method: str, url: str, parameters: Mapping[str, str], consumer_secret: str, token_secret: str = "") -> str:
    """The HMAC-SHA1 signature of a request, in base 64."""
    parts = urlsplit(url)
    pairs = sorted((_quoted(k), _quoted(v)) for k, v in [*parameters.items(), *parse_qsl(parts.query)])
    plain = "&".join(f"{k}={v}" for k, v in pairs)
    base = "&".join(map(_quoted, (method.upper(), f"{parts.scheme}://{parts.netloc}{parts.path}", plain)))
    key = f"{_quoted(consumer_secret)}&{_quoted(token_secret)}".encode()
    return base64.b64encode(hmac.new(key, base.encode(), hashlib.sha1).digest()).decode()


@dataclass
class Client:
    """send(method, url, headers) returns a response's body, so that any transport will do, in tests a recorded one."""

    consumer_key: str
    consumer_secret: str
    send: Send

    def _signed(self, method: str, url: str, token: str = "", secret: str = "", **more: str) -> str:
        oauth = {"oauth_consumer_key": self.consumer_key, "oauth_nonce": secrets.token_hex(16), "oauth_signature_method": "HMAC-SHA1", "oauth_timestamp": str(int(time.time())), "oauth_version": "1.0", **more}
        if token:
            oauth["oauth_token"] = token
        oauth["oauth_signature"] = signature(method, url, oauth, self.consumer_secret, secret)
        return self.send(method, url, {"Authorization": "OAuth " + ", ".join(f'{k}="{_quoted(v)}"' for k, v in sorted(oauth.items()))})

    @staticmethod
    def _token(body: str) -> tuple[str, str]:
        pairs = dict(parse_qsl(body))
        return pairs["oauth_token"], pairs["oauth_token_secret"]

    def request_token(self, url: str, callback: str = "oob") -> tuple[str, str]:
        return self._token(self._signed("GET", url, oauth_callback=callback))

    def access_token(self, url: str, request: tuple[str, str], verifier: str) -> tuple[str, str]:
        return self._token(self._signed("GET", url, *request, oauth_verifier=verifier))

    def session_token(self, url: str, access: tuple[str, str]) -> tuple[str, str]:
        return self._token(self._signed("GET", url, *access))

    def resource(self, url: str, session: tuple[str, str], method: str = "GET", parameters: Mapping[str, str] | None = None) -> str:
        full = f"{url}{'&' if '?' in url else '?'}{urlencode(parameters)}" if parameters else url
        return self._signed(method, full, *session)
