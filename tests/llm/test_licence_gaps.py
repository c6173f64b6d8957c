"""Address rules reach only a few words."""

from gapengine.llm import licences


def test_addresses_hide_nothing_far_behind_them(docs_of):
    notices = "see ruby-lang.org for news and more about the language. Mozilla Public License 2.0, Eclipse Public License, the BSD License, and the end of this license"
    texts = [notices, "http://www.ruby-lang.org/en/about/license.txt", "https://joinup.ec.europa.eu/collection/eupl/eupl-text-eupl-12"]
    got = {r.doc_id: r.labels for r in licences.licence_report(docs_of(*enumerate(texts))).collect()}
    assert got == {0: "bsd,epl,mpl", 1: "ruby", 2: "eupl"}
