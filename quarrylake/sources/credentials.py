"""Storage settings that a catalog service hands out with a table, given to Hadoop's file systems.

They are set for the buckets of the table alone. Two tables of one bucket share them: the one
loaded last counts.
"""

from __future__ import annotations

from urllib.parse import urlsplit

#: Properties of the catalog protocol, and the object store connector's names for them.
SETTINGS = {
    "s3.access-key-id": "access.key",
    "s3.secret-access-key": "secret.key",
    "s3.session-token": "session.token",
    "s3.endpoint": "endpoint",
    "s3.path-style-access": "path.style.access",
    "client.region": "endpoint.region",
}
CONNECTOR = "org.apache.hadoop.fs.s3a."


def by_bucket(answer: dict, location: str, catalog: dict | None = None) -> dict[str, dict[str, str]]:
    """Settings by bucket: the catalog's, the table's config, and over them its credentials of the
    longest prefix that covers the location; other buckets get those credentials that name them."""
    common = (catalog or {}) | (answer.get("config") or {})
    out: dict[str, dict[str, str]] = {}
    here = _bucket(location)
    if here:
        out[here] = dict(common)
    for c in sorted(answer.get("storage-credentials") or [], key=lambda c: len(c.get("prefix", ""))):
        prefix, own = c.get("prefix", ""), c.get("config") or {}
        if here and _covers(prefix, location):
            out[here] |= own
        elif (other := _bucket(prefix)) and other != here:
            out[other] = out.get(other, dict(common)) | own
    return out


def _bucket(location: str) -> str | None:
    u = urlsplit(location)
    return u.netloc if u.scheme in ("s3", "s3a", "s3n") and u.netloc else None


def _covers(prefix: str, location: str) -> bool:
    plain = [x.replace("s3a://", "s3://").replace("s3n://", "s3://") for x in (prefix, location)]
    return plain[0] in ("", "s3", "s3://") or plain[1].startswith(plain[0])


def apply(spark, settings: dict[str, dict[str, str]]) -> None:
    """Set them in the Hadoop configuration that Spark's reads, writes and ``HadoopIO`` start from."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for bucket, own in settings.items():
        at = f"fs.s3a.bucket.{bucket}."
        told = {name: own[key] for key, name in SETTINGS.items() if own.get(key) is not None}
        for name, value in told.items():
            conf.set(at + name, str(value))
        if "access.key" in told:
            kind = "TemporaryAWSCredentialsProvider" if "session.token" in told else "SimpleAWSCredentialsProvider"
            conf.set(at + "aws.credentials.provider", CONNECTOR + kind)
            if "session.token" not in told:
                conf.unset(at + "session.token")
        if told:
            for scheme in ("s3", "s3a"):
                # A cached file system would keep credentials that have been renewed since.
                conf.set(f"fs.{scheme}.impl.disable.cache", "true")
                if conf.get(f"fs.{scheme}.impl") is None:
                    conf.set(f"fs.{scheme}.impl", CONNECTOR + "S3AFileSystem")
                if conf.get(f"fs.AbstractFileSystem.{scheme}.impl") is None:
                    conf.set(f"fs.AbstractFileSystem.{scheme}.impl", CONNECTOR + "S3A")
