"""Byte ranges over HTTP, read in chunks that are kept up to a limit."""

from __future__ import annotations

import io
import threading
import time
import urllib.error
import urllib.request
from collections import OrderedDict
from concurrent.futures import ThreadPoolExecutor


class HttpFile(io.RawIOBase):
    """A read-only file behind a URL. 504 is tried again a few times; a server that ignores ranges is read whole, once."""

    def __init__(self, url: str, auth: tuple[str, str] | None = None, chunk: int = 1 << 20, limit: int = 100 << 20, tries: int = 4):
        self.url, self.chunk, self.most, self.tries, self.at = url, chunk, max(1, limit // chunk), tries, 0
        self.opener = urllib.request.build_opener()
        if auth:
            keep = urllib.request.HTTPPasswordMgrWithDefaultRealm()
            keep.add_password(None, url, *auth)
            self.opener = urllib.request.build_opener(urllib.request.HTTPBasicAuthHandler(keep))
        self.held: OrderedDict[int, bytes] = OrderedDict()
        self.lock = threading.Lock()
        self.whole: bytes | None = None

    def _get(self, i: int) -> bytes:
        with self.lock:
            if i in self.held:
                self.held.move_to_end(i)
                return self.held[i]
        request = urllib.request.Request(self.url, headers={"Range": f"bytes={i * self.chunk}-{(i + 1) * self.chunk - 1}"})
        for k in range(self.tries):
            try:
                with self.opener.open(request, timeout=60) as r:
                    got = r.read()
                    if r.status == 200:
                        self.whole = got
                        return got[i * self.chunk : (i + 1) * self.chunk]
                break
            except urllib.error.HTTPError as e:
                if e.code == 416:
                    got = b""
                    break
                if e.code != 504 or k + 1 == self.tries:
                    raise
                time.sleep(0.1 * 2**k)
        with self.lock:
            self.held[i] = got
            while len(self.held) > self.most:
                self.held.popitem(last=False)
        return got

    def prefetch(self, ranges, threads: int = 8) -> None:
        """Gets the chunks of byte ranges (start, stop) side by side, as many as are kept."""
        wanted = list(dict.fromkeys(i for a, b in ranges for i in range(a // self.chunk, -(-b // self.chunk)) if i not in self.held))[: self.most]
        if self.whole is None and wanted:
            with ThreadPoolExecutor(threads) as pool:
                list(pool.map(self._get, wanted))

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        if whence:
            raise io.UnsupportedOperation("only absolute places")
        self.at = at
        return at

    def read(self, n: int = -1) -> bytes:
        out, end = bytearray(), self.at + n if n >= 0 else 1 << 62
        while self.at < end:
            if self.whole is not None:
                part = self.whole[self.at : end]
            else:
                i, off = divmod(self.at, self.chunk)
                part = self._get(i)[off : off + end - self.at]
            if not part:
                break
            out += part
            self.at += len(part)
        return bytes(out)
