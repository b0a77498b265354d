"""Secrets whose match has to reach beyond their first line or a length."""

import time

import pytest

BODY = "\n".join(["MIIEpAIBAAKCAQEA" + "Ab3+/" * 9 + "xyz"] * 20)
HEAD, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
CASES = {
    f"a\n{HEAD}\n{BODY}\nQ==\n{END}\nb": "a\n[secret]\nb",
    f"a {HEAD}\r\nProc-Type: 4,ENCRYPTED\r\nDEK-Info: AES-128-CBC,0A\r\n\r\nMIIE\r\n{END} b": "a [secret] b",
    f'k = "{HEAD}\\nMIIE\\nQ==\\n{END}\\n"': 'k = "[secret]\\n"',
    f"a\n{HEAD}\n{BODY}\nQ==\nand so on": "a\n[secret]\nand so on",
    f"a\n{HEAD}\nProc-Type: 4,ENCRYPTED\n\n{BODY}": "a\n[secret]",
    f"{HEAD}\n{BODY}\nthen prose\n{HEAD}\n{BODY}\n{END}\nb": "[secret]\nthen prose\n[secret]\nb",
    f"{HEAD} is a header": "[secret] is a header",
    f"go to https://{'u' * 150}:{'p' * 150}@host/x": "go to [secret]host/x",
    "go to https://me:pass@host/x": "go to [secret]host/x",
}


def test_redaction_leaves_nothing_of_a_block(spark):
    from stratadoc.llm.secret_scan import redact

    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    assert [r.text for r in redact(spark, df).orderBy("doc_id").collect()] == list(CASES.values())


@pytest.mark.parametrize("text", [f"{HEAD}\n" * 20_000, f"{HEAD}\n" + "MIIEpAIBAAKCAQEA\n" * 40_000, HEAD + "\n" * 500_000, "https://a:" * 50_000, "https://" + "u:" * 300_000])
def test_time_grows_with_the_text(text):
    from stratadoc.llm.secret_scan import find_spans

    start = time.process_time()
    find_spans(text)
    assert time.process_time() - start < 5
