"""Works, branches, pull requests and repositories from the code host's API.

The client is an object with ``get(path, params) -> JSON``; tests inject one
with canned replies. As a Spark source, a partition is one URL or repository:
each is walked by one task, so listing and downloads run in parallel.
"""

from __future__ import annotations

import base64
import json
import logging
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import EXTENSIONS
from .links import HOST, ContentUrl, RepoUrl

log = logging.getLogger("quillmatch")
PAGE = 100


class SourceError(SystemExit):
    """The host can't be read; ends the run with exit code 1."""

    def __init__(self, message: str) -> None:
        log.error(message)
        super().__init__(1)
        self.message = message


class Client:
    """Plain HTTP, with entity tags so that unchanged replies are not sent again.

    A host that is busy or has counted too many requests is asked again: after
    the time it names, if that is ``patience`` seconds at most, else after
    ``waits`` seconds.
    """

    def __init__(self, token: str = "", api: str = "https://api.github.com", most: int = 500, waits: tuple[float, ...] = (1, 4, 16), patience: float = 3900) -> None:
        self.token, self.api, self.most = token, api, most
        self.waits, self.patience = waits, patience
        self.known: dict[str, tuple[str, object]] = {}

    def get(self, path: str, params: dict | None = None) -> object:
        url = path if path.startswith("http") else f"{self.api}/{path.lstrip('/')}"
        if params:
            url += "?" + urllib.parse.urlencode(params)
        request = urllib.request.Request(url, headers={"Accept": "application/vnd.github.v3+json"})
        if self.token:
            request.add_header("Authorization", f"token {self.token}")
        if url in self.known:
            request.add_header("If-None-Match", self.known[url][0])
        try:
            body, tag = self.ask(request)
        except urllib.error.HTTPError as e:
            if e.code == 304:
                return self.known[url][1]
            if e.code in (400, 403, 404):
                raise SourceError(f"The code host answered {e.code} for {url}: {json.load(e).get('message', '')}") from e
            if e.code == 429 or e.code >= 500:
                raise SourceError(f"The code host answered {e.code} for {url}.") from e
            raise SourceError(f"The code host refused the access token ({e.code}).") from e
        except (urllib.error.URLError, ConnectionError) as e:
            raise SourceError(f"The code host could not be reached: {e}") from e
        if tag:
            if len(self.known) >= self.most:
                self.known.pop(next(iter(self.known)))
            self.known[url] = (tag, body)
        return body

    def ask(self, request: urllib.request.Request) -> tuple[object, str | None]:
        """(body, entity tag) of the first reply that isn't put off."""
        for wait in (*self.waits, None):
            try:
                with urllib.request.urlopen(request) as reply:
                    return json.load(reply), reply.headers.get("ETag")
            except urllib.error.HTTPError as e:
                pause = None if wait is None else self.pause(e, wait)
                if pause is None:
                    raise
                log.warning("The code host answered %s; waiting %.0f s.", e.code, pause)
                time.sleep(pause)
        raise AssertionError("unreachable")

    def pause(self, e: urllib.error.HTTPError, wait: float) -> float | None:
        """Seconds to wait before asking again; null where that is of no use."""
        headers = e.headers or {}
        named = None
        if headers.get("Retry-After", "").isdigit():
            named = float(headers["Retry-After"])
        elif headers.get("X-RateLimit-Remaining") == "0" and headers.get("X-RateLimit-Reset", "").isdigit():
            named = max(0.0, float(headers["X-RateLimit-Reset"]) - time.time()) + 1
        if e.code in (403, 429) and named is not None:
            return named if named <= self.patience else None
        return wait if e.code == 429 or 500 <= e.code < 600 else None


@dataclass(frozen=True)
class Commit:
    sha: str
    date: str


@dataclass(frozen=True)
class Branch:
    name: str
    last_commit: Commit


@dataclass(frozen=True)
class PullRequest:
    number: int
    last_commit_sha: str
    owner: str
    branch: str
    state: str
    draft: bool


@dataclass(frozen=True)
class Repository:
    name: str
    html_url: str


@dataclass(frozen=True)
class Work:
    code: str
    link: str
    commit: Commit


class Host:
    """What the API offers, as iterators."""

    def __init__(self, client, extension: str | None = None, all_branches: bool = False) -> None:
        self.client, self.all_branches = client, all_branches
        self.patterns = [re.compile(p) for p in EXTENSIONS[extension]] if extension else None

    def _pages(self, path: str) -> Iterator[dict]:
        page = 1
        while True:
            rows = self.client.get(path, {"per_page": PAGE, "page": page})
            yield from rows
            if len(rows) < PAGE:
                return
            page += 1

    def _accepts(self, path: str) -> bool:
        return self.patterns is None or any(p.search(path) for p in self.patterns)

    def repositories(self, owner: str, pattern: str | None = None) -> Iterator[Repository]:
        kind = self.client.get(f"/users/{owner}").get("type", "").lower()
        if kind not in ("user", "organization"):
            raise SourceError(f"{owner} is neither a user nor an organization ({kind})")
        for r in self._pages(f"/{'users' if kind == 'user' else 'orgs'}/{owner}/repos"):
            if pattern is None or re.search(pattern, r["name"]):
                yield Repository(r["name"], r["html_url"])

    def pulls(self, owner: str, repo: str) -> Iterator[PullRequest]:
        for p in self._pages(f"/repos/{owner}/{repo}/pulls"):
            commits = self.client.get(p["commits_url"])
            who, branch = p["head"]["label"].split(":", 1)
            yield PullRequest(p["number"], commits[0]["sha"], who, branch, p["state"], p["draft"])

    def default_branch(self, owner: str, repo: str) -> str:
        return self.client.get(f"/repos/{owner}/{repo}")["default_branch"]

    def branch_commit(self, owner: str, repo: str, branch: str) -> Commit:
        c = self.client.get(f"/repos/{owner}/{repo}/branches/{branch}")["commit"]
        return Commit(c["sha"], c["commit"]["author"]["date"])

    def branches(self, owner: str, repo: str) -> Iterator[Branch]:
        for b in self._pages(f"/repos/{owner}/{repo}/branches"):
            yield Branch(b["name"], Commit(b["commit"]["sha"], self.branch_commit(owner, repo, b["name"]).date))

    def path_commit(self, owner: str, repo: str, branch: str, path: str) -> Commit:
        c = self.client.get(f"/repos/{owner}/{repo}/commits", {"path": path, "page": 1, "per_page": 1, "sha": branch})[0]
        return Commit(c["sha"], c["commit"]["author"]["date"])

    def blob(self, owner: str, repo: str, sha: str, commit: Commit, link: str) -> Work:
        content = base64.b64decode(self.client.get(f"/repos/{owner}/{repo}/git/blobs/{sha}")["content"])
        return Work(content.decode("utf-8", errors="ignore"), link, commit)

    def tree(self, owner: str, repo: str, branch: str, sha: str, path: str = "", path_regexp: str | None = None) -> Iterator[Work]:
        """All files below a tree; folders are opened as they come up."""
        open_trees = [iter(self.client.get(f"/repos/{owner}/{repo}/git/trees/{sha}")["tree"])]
        paths = [path]
        while open_trees:
            node = next(open_trees[-1], None)
            if node is None:
                open_trees.pop()
                paths.pop()
                continue
            here = f"{paths[-1]}/{node['path']}"
            link = f"https://{HOST}/{owner}/{repo}/blob/{branch}{here}"
            if node["type"] == "tree":
                self.path_commit(owner, repo, branch, here)
                open_trees.append(iter(self.client.get(f"/repos/{owner}/{repo}/git/trees/{node['sha']}")["tree"]))
                paths.append(here)
            elif node["type"] == "blob" and self._accepts(here) and (path_regexp is None or re.search(path_regexp, link)):
                yield self.blob(owner, repo, node["sha"], self.path_commit(owner, repo, branch, here), link)

    def repository_files(self, url: str, path_regexp: str | None = None) -> Iterator[Work]:
        u = RepoUrl(url)
        if self.all_branches:
            branches = list(self.branches(u.owner, u.repo))
        else:
            name = self.default_branch(u.owner, u.repo)
            branches = [Branch(name, self.branch_commit(u.owner, u.repo, name))]
        for b in branches:
            yield from self.tree(u.owner, u.repo, b.name, b.last_commit.sha, "", path_regexp)

    def content_files(self, url: str, path_regexp: str | None = None) -> Iterator[Work]:
        u = ContentUrl(url)
        reply = self.client.get(f"/repos/{u.owner}/{u.repo}/contents/{u.path}", {"ref": u.branch})
        if isinstance(reply, dict):
            yield self.blob(u.owner, u.repo, reply["sha"], self.path_commit(u.owner, u.repo, u.branch, u.path), str(u))
        elif isinstance(reply, list):
            for node in reply:
                path = f"/{node['path']}"
                link = f"https://{HOST}/{u.owner}/{u.repo}/tree/{u.branch}{path}"
                if node["type"] == "dir":
                    self.path_commit(u.owner, u.repo, u.branch, path)
                    yield from self.tree(u.owner, u.repo, u.branch, node["sha"], path, path_regexp)
                elif node["type"] == "file" and self._accepts(node["name"]) and (path_regexp is None or re.search(path_regexp, link)):
                    yield self.blob(u.owner, u.repo, node["sha"], self.path_commit(u.owner, u.repo, u.branch, path), link)
        else:
            raise TypeError(f"unexpected request type from {url}, expected: list or dict, got {type(reply)}")


class _Part(InputPartition):
    def __init__(self, kind: str, target: str) -> None:
        super().__init__((kind, target))
        self.kind, self.target = kind, target


class _Reader(DataSourceReader):
    def __init__(self, table: str, options: dict, client) -> None:
        self.table, self.options, self.client = table, options, client

    def _host(self) -> Host:
        return Host(self.client or Client(self.options.get("token", ""), self.options.get("api", "https://api.github.com")), self.options.get("extension"), self.options.get("allbranches", "false") == "true")

    def partitions(self):
        urls = [u for u in self.options.get("urls", "").split(",") if u]
        if self.table != "works":
            return [_Part("repo", u) for u in urls]
        parts = [_Part("content", u) for u in urls]
        if user := self.options.get("user"):
            parts += [_Part("repo", r.html_url) for r in self._host().repositories(user, self.options.get("reporegexp"))]
        return parts

    def read(self, part):
        host, regexp = self._host(), self.options.get("pathregexp")
        if self.table == "works":
            files = host.content_files(part.target, regexp) if part.kind == "content" else host.repository_files(part.target, regexp)
            for w in files:
                yield w.link, w.code, w.commit.date, part.target
            return
        u = RepoUrl(part.target)
        if self.table == "branches":
            for b in host.branches(u.owner, u.repo):
                yield part.target, b.name, b.last_commit.sha, b.last_commit.date
        else:
            for p in host.pulls(u.owner, u.repo):
                yield part.target, p.number, p.last_commit_sha, p.owner, p.branch, p.state, p.draft


class HostSource(DataSource):
    """``spark.read.format("code_host")`` with options table (works, branches or
    pulls), urls (comma-separated), user, repoRegexp, pathRegexp, extension,
    allBranches and token."""

    client = None
    TABLES = {
        "works": "filepath string, code string, modify_date string, collection_id string",
        "branches": "repo string, name string, sha string, date string",
        "pulls": "repo string, number int, last_commit_sha string, owner string, branch string, state string, draft boolean",
    }

    @classmethod
    def name(cls) -> str:
        return "code_host"

    def _table(self) -> str:
        return self.options.get("table", "works")

    def schema(self) -> str:
        return self.TABLES[self._table()]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._table(), {k.lower(): v for k, v in dict(self.options).items()}, self.client)
