"""Sources for tests."""

import json

from jobweave.sources.adapter import Answer


def two_pages(slug, page):
    if slug == "gone":
        return Answer(None, 404)
    return Answer(json.dumps({"jobs": [{"id": f"{slug}{page}", "title": "Dev"}]}), more=page == 0)


def refused(slug, page):
    return Answer("{}", 429 if slug == "b" else 200)


def noted(slug, request):
    """Pages of slug (folder|name|pages|mode), each of which is noted in the folder as it is asked for."""
    import os
    import time

    folder, name, pages, mode = slug.split("|")
    k = request.offset // request.limit if request.token is None else int(request.token)
    with open(f"{folder}/asked", "a") as f:
        f.write(f"{name} {k}\n")
    if mode == "raises" and k == 1:
        raise RuntimeError("connection lost")
    if mode == "refused":
        return Answer("{}", 429)
    if mode == "broken" and k == 1:
        return Answer('{"content": {}}')
    if mode == "text" and k == 1:
        return Answer("<html>")
    if mode == "slow":
        time.sleep(0.2)
    if os.path.exists(f"{folder}/down"):
        raise SystemExit("killed")
    own = [{"id": f"{name}-{k}-{j}"} for j in range(request.limit)] if k < int(pages) else []
    total = {"total": int(pages) * request.limit, "wrong": "many", "text total": str(int(pages) * request.limit)}.get(mode)
    return Answer(json.dumps({"content": own, "results": own, "totalFound": total, "nextPage": str(k + 1) if k + 1 < int(pages) else None}))
