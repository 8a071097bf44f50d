"""Deliveries over HTTP; reachability of packages."""

import http.client
import json
import threading

from palisade.functions import answers as A
from palisade.operators import reachability as R
from palisade.plans import postprocess as P
from palisade.schema import as_findings
from palisade.streaming import receiver, webhook


def test_deliveries_reach_the_stream(spark, tmp_path):
    server = receiver.receiver(f"{tmp_path}/in", 0, "127.0.0.1")
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(method, path, body=None, headers=None):
        c = http.client.HTTPConnection("127.0.0.1", server.server_address[1], timeout=10)
        c.request(method, path, body, headers or {})
        r = c.getresponse()
        return r.status, r.read()

    try:
        assert ask("GET", "/healthz") == (200, b"ok\n") and ask("GET", "/x")[0] == 404 and ask("POST", "/x", "{}")[0] == 404
        body = json.dumps({"ref": "refs/heads/main", "after": "s1", "repository": {"full_name": "o/r"}})
        assert ask("POST", "/webhook", body, {"X-GitHub-Event": "push", "X-Hub-Signature-256": "sha256=0"})[0] == 202
        assert ask("POST", "/webhook", "nö\n".encode(), {"X-GitHub-Event": "ping"})[0] == 202
        c = http.client.HTTPConnection("127.0.0.1", server.server_address[1], timeout=10)
        c.putrequest("POST", "/webhook")
        c.putheader("Content-Length", str(webhook.MAX_BODY + 1))
        c.endheaders()
        assert c.getresponse().status == 413
    finally:
        server.shutdown()
        server.server_close()
    assert sorted(p.suffix for p in (tmp_path / "in").iterdir()) == [".json", ".json"]
    q = webhook.requests(receiver.deliveries(spark, f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.kind, r.repository, r.sha) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("push", "o/r", "s1")]


def test_reachability_asks_only_about_what_is_imported(spark):
    files = spark.createDataFrame([("a.py", "import requests\n" + "x\n" * 400), ("b.py", "from requests import get"), ("c.py", "nothing"), ("d.py", None)], "path string, text string")
    rows = [("A-1", "requests"), ("A-2", "requests"), ("A-3", "absent"), ("A-4", "broken")]
    files = files.union(spark.createDataFrame([("e.py", "import broken")], files.schema))
    sca = spark.createDataFrame(rows, "r string, n string")
    f = P.with_fingerprints(P.union([as_findings(sca, type="sca", rule_id=sca.r, severity=3, title="t", description="d", package_name=sca.n, package_version="1", ecosystem="PyPI"), as_findings(spark.range(1), type="sast", rule_id="s", severity=3, title="t")]))
    prompts = {r.fingerprint: r.prompt for r in R.reachability_prompts(f, files).collect()}
    assert len(prompts) == 4 and sum(p is None for p in prompts.values()) == 1
    one = next(p for p in prompts.values() if p and p.startswith("A-1"))
    assert one.index("### a.py") < one.index("### b.py") and one.count("\nx") == 299

    def model(texts):
        return ["reachability: Reachable\nreason: it calls get" if "requests" in t else 1 / 0 for t in texts]

    from palisade.functions import limits

    with limits.shared(spark, 1000, 200, 0.1) as limiter:
        got = {r.rule_id: r for r in R.with_reachability(f, files, model, limiter).collect()}
    assert got["A-1"].tags[-1] == got["A-2"].tags[-1] == "reachable" and got["A-1"].confidence == "high" and got["A-1"].description == "d | it calls get"
    assert got["A-3"].tags[-1] == got["A-4"].tags[-1] == "reachability-unknown" and got["A-3"].description.endswith(R.NOT_IMPORTED) and got["A-4"].description.endswith(R.NO_ANSWER)
    assert got["s"].tags == [] and len(got) == 5
    assert A.complete(spark.createDataFrame([], "prompt string"), model).count() == 0
