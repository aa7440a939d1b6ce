"""A rule-based annotator that the registered queries and the tests use."""

from __future__ import annotations

import json
import re

from agora import schemas
from agora.operators import annotate


class OfflineAnnotator:
    """A deterministic, rule-based annotator (no network) for tests and replays.

    Posts: category by text length, summary = first 40 characters, idea flag =
    even length, keywords = [length]. Some ids are written in a damaged form
    (exercising the lenient id parse and the summary fallback), some posts get
    two results (the last wins), and the answer shape rotates between a plain
    array, a fenced block and a wrapper object.
    Comments: category / sentiment by text length; some ids are damaged (strict
    parse rejects them).
    """

    POST_LINE = re.compile(r"\[POST_ID_(\d+): (.*?)\]\n(?=\[POST_ID_\d+: |\Z)", re.S)
    COMMENT_LINE = re.compile(r"\[COMMENT_ID_(\d+): (.*?)\]\n(?=\[COMMENT_ID_\d+: |\Z)", re.S)

    def __call__(self, system: str, user: str) -> str:
        if user.startswith("Posts:\n"):
            return self._posts(user[len("Posts:\n"):])
        return self._comments(user[len("Comments:\n"):])

    @staticmethod
    def post_category(n: int) -> str:
        if n < 500:
            return "General Discussion"
        if n < 2000:
            return "Question/Inquiry"
        if n < 10000:
            return "Problem Statement"
        return "Project Idea"

    def _posts(self, body: str) -> str:
        res = []
        first = None
        for m in self.POST_LINE.finditer(body):
            pid, text = int(m.group(1)), m.group(2)
            first = pid if first is None else first
            n = len(text)
            if pid % 7 == 3:
                tag = f"POST_{pid}"                     # unparseable -> summary fallback
            elif pid % 11 == 5:
                tag = f"POST_ID_{pid}: see text"        # lenient parse
            else:
                tag = f"POST_ID_{pid}"
            r = {"postId": tag, "category": self.post_category(n), "subCategory": None,
                 "keywords": [str(n)], "summary": text[:40], "isPotentialIdea": n % 2 == 0,
                 "reasoning": "length rule"}
            res.append(r)
            if pid % 13 == 0:                           # a second answer: the last wins
                res.append({**r, "postId": f"POST_ID_{pid}", "category": "Other"})
        body_json = json.dumps(res, ensure_ascii=False)
        shape = (first or 0) % 3
        if shape == 1:
            return f"Here are the results:\n```json\n{body_json}\n```"
        if shape == 2:
            return json.dumps({"results": res}, ensure_ascii=False)
        return body_json

    def _comments(self, body: str) -> str:
        res = []
        first = None
        for m in self.COMMENT_LINE.finditer(body):
            cid, text = int(m.group(1)), m.group(2)
            first = cid if first is None else first
            n = len(text)
            tag = f"COMMENT_ID_{cid}x" if cid % 9 == 4 else f"COMMENT_ID_{cid}"
            res.append({"comment_id": tag,
                        "category": schemas.COMMENT_CATEGORIES[n % 8],
                        "sentiment": schemas.COMMENT_SENTIMENTS[n % 3],
                        "keywords": [str(n)]})
        if (first or 0) % 2 == 0:
            return json.dumps({"comments": res}, ensure_ascii=False)
        return json.dumps(res, ensure_ascii=False)


annotate.register_annotator("offline", OfflineAnnotator)


class FailingAnnotator(OfflineAnnotator):
    """The same, but every prompt whose length is a multiple of three fails for good while ``failing``."""

    def __init__(self, failing: bool = True):
        self.failing = failing

    def __call__(self, system: str, user: str) -> str:
        if self.failing and len(user) % 3 == 0:
            raise ValueError("no answer for this prompt")
        return super().__call__(system, user)


annotate.register_annotator("offline_failing", FailingAnnotator)
