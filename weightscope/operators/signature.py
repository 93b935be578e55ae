"""What signature files beside an artifact prove. Files are small; this is plain Python on executors."""

from __future__ import annotations

import json

from weightscope.functions import ed25519
from weightscope.sources import walk


def _fixed(data: bytes, n: int) -> bytes | None:
    """Exactly n bytes, raw or as hex."""
    if len(data) == n:
        return data
    try:
        out = bytes.fromhex(data.decode("ascii").strip())
    except (UnicodeDecodeError, ValueError):
        return None
    return out if len(out) == n else None


def _finding(id_: str, severity: str, detail: str, *evidence: str) -> dict:
    return {"id": id_, "severity": severity, "detail": detail, "evidence": list(evidence)}


def is_sigstore(doc) -> bool:
    """Is a JSON document a Sigstore bundle?"""
    return isinstance(doc, dict) and (any(k in doc for k in ("verificationMaterial", "messageSignature", "tlogEntries")) or (isinstance(doc.get("mediaType"), str) and "sigstore" in doc["mediaType"]))


def _sigstore(path: str) -> tuple[str, dict]:
    return "unverified (sigstore)", _finding("SIG_SIGSTORE_UNVERIFIED", "info", "a Sigstore bundle is there, but certificate and log chains are not checked", path)


def evaluate(artifact: str, manifest: str | None, bundle: str | None = None, key: str | None = None) -> tuple[str, dict | None]:
    """Status and finding for an artifact with a computed manifest hash.

    The bundle is the one given or the first beside the artifact. JSON bundles
    are Sigstore's, or name a manifest to compare with; others are detached
    Ed25519 signatures of the manifest hash's text, raw or in hex.
    """
    path = bundle or walk.sidecar(artifact)
    if path is None:
        return "unsigned", None
    try:
        with open(path, "rb") as f:
            raw = f.read()
    except OSError as e:
        return "unsigned", _finding("SIG_BUNDLE_UNREADABLE", "low", f"the signature file {path} can't be read: {e}")
    try:
        doc = json.loads(raw)
    except ValueError:
        doc = None
    if doc is not None and not isinstance(doc, (int, float, str)):
        if is_sigstore(doc):
            return _sigstore(path)
        expected = doc.get("manifest") if isinstance(doc, dict) else None
        if not isinstance(expected, str):
            return "unverified", _finding("SIG_UNRECOGNIZED", "low", "the signature file's JSON is of no known kind", path)
        if manifest is None:
            return "unverified", _finding("SIG_NO_MANIFEST", "low", "a manifest is recorded, but none could be computed to compare it with")
        if manifest == expected:
            return "signed", _finding("SIG_MANIFEST_MATCH", "info", "the computed manifest hash is the recorded one", path)
        return "signature-mismatch", _finding("SIG_MISMATCH", "high", "the computed manifest hash differs from the recorded one", f"expected {expected}, computed {manifest}")
    if path.endswith((".sigstore", ".bundle")):
        return _sigstore(path)
    if key is None:
        return "unverified", _finding("SIG_NO_KEY", "info", "a detached signature is there, but no public key to check it with", path)
    if manifest is None:
        return "unverified", _finding("SIG_NO_MANIFEST", "low", "a signature is there, but no manifest hash could be computed to check it against")
    try:
        with open(key, "rb") as f:
            key_raw = f.read()
    except OSError as e:
        return "unverified", _finding("SIG_KEY_UNREADABLE", "low", f"the key {key} can't be read: {e}")
    public, signature = _fixed(key_raw, 32), _fixed(raw, 64)
    for good, what in ((public, "the public key is not 32 bytes, raw or in hex"), (signature, "the signature is not 64 bytes, raw or in hex")):
        if good is None:
            return "unverified", _finding("SIG_ERROR", "low", what)
    if not ed25519.is_key(public):
        return "unverified", _finding("SIG_ERROR", "low", "the public key is no Ed25519 point")
    if ed25519.verify(public, manifest.encode(), signature):
        return "signed", _finding("SIG_VERIFIED", "info", "the detached signature of the manifest hash is valid", path)
    return "signature-mismatch", _finding("SIG_MISMATCH", "high", "the detached signature does not fit the manifest hash and the key")
