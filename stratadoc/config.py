"""Limits, namespaces and access levels."""

from __future__ import annotations

from dataclasses import dataclass, field

from stratadoc.errors import EngineError


@dataclass(frozen=True)
class Limits:
    record_bytes: int = 1 << 20
    container_elements: int = 1000  # of an object or array; the root is not tested
    value_bytes: int = 1024
    total_keys: int = 1000
    query_rows: int = 1000
    request_lines: int = 100_000
    line_bytes: int = 1 << 20
    sync_batch_bytes: int = 1 << 20
    debounce_seconds: int = 60
    sync_group_bytes: int = 16 << 20  # of consecutive new batches that are tried as one commit
    refusal_seconds: float = 1.0  # how long an unauthorized call takes at least


@dataclass(frozen=True)
class Access:
    query: bool = False
    ingest: bool = False


@dataclass(frozen=True)
class Client:
    name: str
    secret: str
    access: dict[str, Access] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len(self.secret) < 64:
            raise ValueError("a client secret has at least 64 characters")


@dataclass(frozen=True)
class Config:
    namespaces: tuple[str, ...] = ("main",)
    clients: tuple[Client, ...] = ()
    limits: Limits = Limits()
    semantics: str = "reference"
    accept_host: str | None = None  # the Host that calls must name; None: any

    def __post_init__(self) -> None:
        if self.semantics not in ("reference", "intended"):
            raise ValueError("semantics is 'reference' or 'intended'")

    def check_namespace(self, namespace: str) -> str:
        if namespace not in self.namespaces:
            raise EngineError("bad_request.unknown_namespace", f"unknown namespace: {namespace}", namespace=namespace)
        return namespace

    def allows(self, host: str | None, name: str | None, secret: str | None, namespace: str, kind: str) -> bool:
        """Whether a call may go on. Without configured clients the engine is used within one process, by its owner."""
        if self.accept_host is not None and host != self.accept_host:
            return False
        return not self.clients or self.authorize(name or "", secret or "", namespace, kind)

    def authorize(self, name: str, secret: str, namespace: str, kind: str) -> bool:
        import hmac

        found = next((c for c in self.clients if c.name == name), None)
        same = hmac.compare_digest((found.secret if found else "").encode(), secret.encode())
        access = found.access.get(namespace, Access()) if found else Access()
        return bool(found) and same and (access.query if kind == "query" else access.ingest)
