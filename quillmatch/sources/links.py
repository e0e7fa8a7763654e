"""Links to the code host."""

from __future__ import annotations

HOST = "github.com"


class HostUrl(str):
    """A link to the host; ``parts`` are its pieces between slashes."""

    parts: list[str]

    def __new__(cls, url: str):
        parts = url.rstrip("/").split("/")
        if len(parts) < 3 or parts[0] not in ("https:", "http:") or parts[1] or parts[2] != HOST:
            raise ValueError(f"{url} does not point to {HOST}")
        out = super().__new__(cls, url)
        out.parts, out.protocol, out.host = parts, parts[0][:-1], HOST
        return out


class RepoUrl(HostUrl):
    def __new__(cls, url: str):
        out = super().__new__(cls, url)
        if len(out.parts) != 5:
            raise ValueError(f"{url} does not point to a repository")
        out.owner, out.repo = out.parts[3:]
        return out


class ContentUrl(HostUrl):
    def __new__(cls, url: str):
        out = super().__new__(cls, url)
        if len(out.parts) <= 7:
            raise ValueError(f"{url} does not point to a file or folder of a repository")
        out.owner, out.repo, out.branch = out.parts[3], out.parts[4], out.parts[6]
        out.path = "/".join(out.parts[7:])
        return out
