"""Catalogs: tables in a folder, and tables behind a REST service."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request

from ..plans import commit
from ..table import FileStore, Table, new_metadata
from . import credentials
from . import metadata as md
from .fileio import AlreadyExists, CachingIO, io_for


class FileCatalog:
    """Tables below a warehouse folder, ``warehouse/ns/table``; their metadata files are the
    catalog. Names are ``table`` or ``ns.table``, or a location."""

    def __init__(self, spark, warehouse: str, io=None):
        self.spark, self.warehouse = spark, warehouse.rstrip("/")
        self.io = io or CachingIO(io_for(warehouse, spark))

    def location(self, name: str) -> str:
        return name if "/" in name else f"{self.warehouse}/{name.replace('.', '/')}"

    def create_table(self, name: str, schema: dict, spec: list[dict] | None = None, sort_order: list[dict] | None = None, properties: dict | None = None, version: int = 2) -> Table:
        """Write the first metadata version, which fails if there is one, then the hint."""
        location = self.location(name)
        meta = new_metadata(location, schema, spec, sort_order, properties, version)
        if md.listed(self.io, location):
            raise AlreadyExists(location)
        self.io.write(f"{location}/metadata/v1.metadata.json", md.dumps(meta), only_new=True)
        self.io.write(f"{location}/metadata/version-hint.text", b"1")
        return Table(self.spark, FileStore(self.io, location), meta, "v1.metadata.json")

    def load_table(self, name: str, metadata_file: str | None = None) -> Table:
        """The current table, or as of an earlier metadata file."""
        store = FileStore(self._fresh(), self.location(name))
        return Table(self.spark, store, *md.load(store.io, store.location, metadata_file))

    def _fresh(self):
        return CachingIO(self.io.inner) if isinstance(self.io, CachingIO) else self.io

    def table_exists(self, name: str) -> bool:
        return bool(md.listed(self.io, self.location(name)))

    def list_tables(self, namespace: str = "") -> list[str]:
        at = f"{self.warehouse}/{namespace.replace('.', '/')}" if namespace else self.warehouse
        return [n for n in self.io.list(at) if md.listed(self.io, f"{at}/{n}")]

    def versions(self, name: str) -> list[str]:
        return md.versions(self.io, self.location(name))

    def drop_table(self, name: str, purge: bool = False) -> None:
        """Remove the metadata, and with ``purge`` everything below the table's folder."""
        location = self.location(name)
        if not self.table_exists(name):
            raise FileNotFoundError(location)
        self.io.delete(location if purge else f"{location}/metadata")


class RestError(Exception):
    def __init__(self, status: int, kind: str, message: str):
        super().__init__(f"{status} {kind}: {message}")
        self.status, self.kind = status, kind


class RestCatalog:
    """Client of the open REST catalog protocol.

    ``sign(method, url, headers, body)`` may add headers to each request (see sigv4).
    """

    def __init__(self, spark, url: str, token: str | None = None, warehouse: str | None = None, sign=None, io=None, headers: dict | None = None):
        self.spark, self.url, self.token, self.sign, self.io, self.headers = spark, url.rstrip("/"), token, sign, io, headers or {}
        told = self._call("GET", "config", query={"warehouse": warehouse} if warehouse else None, prefixed=False)
        self.config = (told.get("defaults") or {}) | (told.get("overrides") or {})
        self.prefix = self.config.get("prefix", "")

    @staticmethod
    def _ns(namespace: str | list[str]) -> str:
        parts = namespace.split(".") if isinstance(namespace, str) else namespace
        return urllib.parse.quote("\x1f".join(parts), safe="")

    def _call(self, method: str, path: str, body: dict | None = None, query: dict | None = None, prefixed: bool = True, headers: dict | None = None) -> dict:
        prefix = "/".join(urllib.parse.quote(p, safe="") for p in self.prefix.split("/")) + "/" if prefixed and self.prefix else ""
        url = f"{self.url}/v1/{prefix}{path}"
        if query:
            url += "?" + urllib.parse.urlencode({k: v for k, v in query.items() if v is not None})
        data = json.dumps(body).encode() if body is not None else None
        head = {"Accept": "application/json"} | self.headers | ({"Content-Type": "application/json"} if data else {}) | (headers or {})
        if self.token:
            head["Authorization"] = f"Bearer {self.token}"
        if self.sign:
            head |= self.sign(method, url, head, data or b"")
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, head, method=method), timeout=60) as r:
                text = r.read()
                return json.loads(text) if text else {}
        except urllib.error.HTTPError as e:
            text = e.read()
            try:
                error = json.loads(text).get("error") or {}
            except ValueError:
                error = {}
            raise RestError(e.code, error.get("type", "Error"), error.get("message", text.decode("utf-8", "replace")[:300])) from e

    def _pages(self, path: str, key: str, query: dict | None = None) -> list:
        out, token = [], None
        while True:
            r = self._call("GET", path, query=(query or {}) | ({"pageToken": token} if token else {}))
            out += r.get(key) or []
            token = r.get("next-page-token")
            if not token:
                return out

    def list_namespaces(self, parent: str | None = None) -> list[str]:
        q = {"parent": "\x1f".join(parent.split("."))} if parent else None
        return [".".join(n) for n in self._pages("namespaces", "namespaces", q)]

    def create_namespace(self, namespace: str, properties: dict | None = None) -> dict:
        return self._call("POST", "namespaces", {"namespace": namespace.split("."), "properties": properties or {}})

    def load_namespace(self, namespace: str) -> dict:
        return self._call("GET", f"namespaces/{self._ns(namespace)}")

    def drop_namespace(self, namespace: str) -> None:
        self._call("DELETE", f"namespaces/{self._ns(namespace)}")

    def list_tables(self, namespace: str) -> list[str]:
        return [".".join([*i["namespace"], i["name"]]) for i in self._pages(f"namespaces/{self._ns(namespace)}/tables", "identifiers")]

    def _at(self, name: str) -> tuple[str, str]:
        namespace, _, table = name.rpartition(".")
        return f"namespaces/{self._ns(namespace)}/tables", urllib.parse.quote(table, safe="")

    def _table(self, name: str, r: dict) -> Table:
        return Table(self.spark, RestStore(self, name, r), r["metadata"], r.get("metadata-location") or "")

    def load_table(self, name: str, delegation: str | None = None) -> Table:
        at, table = self._at(name)
        head = {"X-Iceberg-Access-Delegation": delegation} if delegation else None
        r = self._call("GET", f"{at}/{table}", headers=head)
        if delegation == "vended-credentials" and not r.get("storage-credentials") and "s3.access-key-id" not in (r.get("config") or {}):
            r = r | {"storage-credentials": self.load_credentials(name)}
        return self._table(name, r)

    def load_credentials(self, name: str) -> list[dict]:
        at, table = self._at(name)
        return self._call("GET", f"{at}/{table}/credentials").get("storage-credentials") or []

    def create_table(self, name: str, schema: dict, spec: list[dict] | None = None, sort_order: list[dict] | None = None, properties: dict | None = None, version: int = 2, location: str | None = None) -> Table:
        at, table = self._at(name)
        draft = new_metadata(location or "", schema, spec, sort_order, properties, version)
        body = {"name": urllib.parse.unquote(table), "schema": draft["schemas"][0], "partition-spec": draft["partition-specs"][0], "write-order": draft["sort-orders"][-1], "properties": (properties or {}) | {"format-version": str(version)}, "stage-create": False}
        return self._table(name, self._call("POST", at, body | ({"location": location} if location else {})))

    def register_table(self, name: str, metadata_location: str) -> Table:
        namespace, _, table = name.rpartition(".")
        return self._table(name, self._call("POST", f"namespaces/{self._ns(namespace)}/register", {"name": table, "metadata-location": metadata_location}))

    def drop_table(self, name: str, purge: bool = False) -> None:
        at, table = self._at(name)
        self._call("DELETE", f"{at}/{table}", query={"purgeRequested": "true" if purge else "false"})

    def rename_table(self, old: str, new: str) -> None:
        parts = lambda n: {"namespace": n.split(".")[:-1], "name": n.split(".")[-1]}
        self._call("POST", "tables/rename", {"source": parts(old), "destination": parts(new)})

    def commit(self, name: str, requirements: list[dict], updates: list[dict]) -> dict:
        at, table = self._at(name)
        try:
            return self._call("POST", f"{at}/{table}", {"requirements": requirements, "updates": updates})
        except RestError as e:
            if e.status in (409, 412):
                raise commit.CommitConflict(str(e)) from e
            raise


class RestStore:
    """A table of a REST catalog; the service checks requirements and writes metadata."""

    def __init__(self, catalog: RestCatalog, name: str, r: dict):
        self.catalog, self.table = catalog, name
        self.location = r["metadata"]["location"].rstrip("/")
        self._told(r)
        self.io = catalog.io or io_for(self.location, catalog.spark)

    def _told(self, r: dict) -> None:
        """Storage settings that came with the table reach the file systems."""
        credentials.apply(self.catalog.spark, credentials.by_bucket(r, self.location, self.catalog.config))

    def load(self) -> tuple[dict, str]:
        at, table = self.catalog._at(self.table)
        r = self.catalog._call("GET", f"{at}/{table}")
        self._told(r)
        return r["metadata"], r.get("metadata-location") or ""

    def commit(self, meta: dict, name: str, requirements: list[dict], updates: list[dict]) -> tuple[dict, str]:
        r = self.catalog.commit(self.table, requirements, updates)
        return r["metadata"], r.get("metadata-location") or ""


def table_buckets(spark, region: str, arn: str, credentials: dict, clock=time.time) -> RestCatalog:
    """REST catalog of table buckets in an object store, with signed requests; files are reached
    with the same credentials unless the service hands out others."""
    from .sigv4 import signer

    catalog = RestCatalog(spark, f"https://s3tables.{region}.amazonaws.com/iceberg", warehouse=arn, sign=signer(region, "s3tables", credentials, clock))
    names = {"s3.access-key-id": "access_key", "s3.secret-access-key": "secret_key", "s3.session-token": "session_token"}
    catalog.config = {"client.region": region} | {k: credentials[v] for k, v in names.items() if credentials.get(v)} | catalog.config
    return catalog
