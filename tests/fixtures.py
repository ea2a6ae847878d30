"""Small synthetic containers in the formats of the sources."""

import gzip
import io
import json
import os
import tarfile
import zipfile

WORK_A = {
    "DOI": "10.9000/A", "title": ["One", "Two"], "published": {"date-parts": [[2020, 5]]}, "type": "journal-article", "references-count": 2, "issn-type": [{"type": "print", "value": "1234-5678"}, {"type": "electronic", "value": "8765-432X"}],
    "author": [
        {"given": "Ada", "family": "Green", "ORCID": "http://orcid.org/0000-0001", "authenticated-orcid": True, "affiliation": [{"name": "Alpha"}, {"name": "Beta"}]},
        {"given": "Bo", "family": "Brown"},
    ],
    "reference": [{"key": "r1", "DOI": "10.9000/ B"}, {"key": "r2", "unstructured": "x"}], "subject": ["Ecology"], "funder": [{"name": "Fund", "DOI": "10.9000/F", "award": ["A-1", "A-2"]}],
    "update-to": [{"label": "Correction", "DOI": "10.9000/Z", "updated": {"timestamp": 5}}], "license": [{"URL": "http://l", "start": {"timestamp": 7}, "delay-in-days": 0}], "link": [{"URL": "http://k", "content-type": "pdf"}],
}
WORK_B = {"DOI": "10.9000/B&amp;lt;x", "published": {"date-parts": [[None]]}}
WORK_C = {"DOI": "10.9000/C 10.9000/C", "title": ["Three"], "published": {"date-parts": [[1999]]}, "author": [{"given": "Cy", "family": "Green", "affiliation": []}]}


def crossref(folder):
    os.makedirs(folder, exist_ok=True)
    with gzip.open(os.path.join(folder, "0.json.gz"), "wt") as f:
        f.write(json.dumps({"items": [WORK_A, WORK_B]}, indent=1))
    with gzip.open(os.path.join(folder, "1.json.gz"), "wt") as f:
        f.write(json.dumps(WORK_C) + "\n")
    return str(folder)


def _tar(path, members):
    with tarfile.open(path, "w:gz") as t:
        for name, text in members:
            data = text.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return str(path)


def datacite(path):
    a = {"doi": "10.9/a", "sizes": ["1 MB"], "publicationYear": 2001, "creators": [{"name": "N", "affiliation": {"name": "X"}, "nameIdentifiers": [{"nameIdentifier": "i"}]}], "titles": [{"title": "T"}], "geoLocations": [{"geoLocationPoint": {"pointLongitude": "1.5", "pointLatitude": ""}}]}
    return _tar(path, [("./10.9/part_0.jsonl", json.dumps(a) + "\n" + json.dumps({"doi": "10.9/b"}) + "\n"), ("./10.9/part_1.jsonl", json.dumps({"doi": "10.9/c", "contributors": [{"name": "C"}]}) + "\n")])


PUBMED = """<?xml version="1.0"?><PubmedArticleSet><PubmedArticle><MedlineCitation Status="MEDLINE"><PMID>1</PMID><Article PubModel="Print"><Journal><ISSN IssnType="Print">1</ISSN><JournalIssue><Volume>12A</Volume><PubDate><Year>2001</Year><Month>Jan</Month></PubDate></JournalIssue></Journal>
<ArticleTitle>Some <i>x</i> title</ArticleTitle><Abstract><AbstractText Label="B">Lead <b>bold</b> tail</AbstractText><AbstractText><i>first</i> rest</AbstractText></Abstract>
<AuthorList><Author ValidYN="Y"><LastName>Green</LastName><ForeName>Ada</ForeName><Identifier Source="ORCID">https://orcid.org/0000-1</Identifier><AffiliationInfo><Affiliation>Alpha</Affiliation></AffiliationInfo><AffiliationInfo><Affiliation>Beta</Affiliation></AffiliationInfo></Author><Author ValidYN="Y"><LastName>Brown</LastName></Author></AuthorList></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="pii">p</ArticleId><ArticleId IdType="doi">10.9/x</ArticleId></ArticleIdList><ReferenceList><Reference><Citation>C1</Citation><ArticleIdList><ArticleId IdType="pubmed">7</ArticleId></ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>2</PMID></MedlineCitation></PubmedArticle></PubmedArticleSet>"""


def pubmed(folder):
    os.makedirs(folder, exist_ok=True)
    with gzip.open(os.path.join(folder, "pubmed01.xml.gz"), "wt") as f:
        f.write(PUBMED)
    with open(os.path.join(folder, "readme.txt"), "w") as f:
        f.write("no container")
    return str(folder)


PERSON = """<record:record xmlns:record="r" xmlns:common="c" xmlns:person="p" xmlns:pd="d" xmlns:a="a" xmlns:e="e" xmlns:k="k"><common:orcid-identifier><common:path>0000-1</common:path></common:orcid-identifier>
<person:person><person:name><pd:given-names>Ada</pd:given-names><pd:family-name>Green</pd:family-name></person:name><k:keywords><k:keyword><k:content>bees</k:content></k:keyword><k:keyword><k:content>ants</k:content></k:keyword></k:keywords></person:person>
<a:activities-summary><a:educations><a:affiliation-group><e:education-summary><common:department-name>Bio</common:department-name><common:start-date><common:year>1990</common:year></common:start-date><common:organization><common:name>Alpha</common:name><common:address><common:city>Town</common:city></common:address></common:organization></e:education-summary></a:affiliation-group></a:educations>
<a:works><a:group><common:external-ids><common:external-id><common:external-id-type>isbn</common:external-id-type><common:external-id-value>1</common:external-id-value></common:external-id></common:external-ids></a:group><a:group><common:external-ids><common:external-id><common:external-id-type>doi</common:external-id-type><common:external-id-value>10.9/X</common:external-id-value></common:external-id></common:external-ids></a:group></a:works></a:activities-summary></record:record>"""


def orcid(path):
    return _tar(path, [("s/1/0000-1.xml", PERSON), ("s/2/0000-2.xml", "<error:error xmlns:error='x'><error:response-code>9</error:response-code></error:error>")])


def patent(n, extra=""):
    return f"""<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE us-patent-grant SYSTEM "x.dtd" [ ]>
<us-patent-grant lang="EN" country="US" file="F{n}"><us-bibliographic-data-grant><invention-title>T{n}</invention-title><classifications-cpc><main-cpc><classification-cpc><section>A</section></classification-cpc></main-cpc><further-cpc/></classifications-cpc>
<us-references-cited><us-citation><nplcit num="1"><othercit>Foo, doi: 10.1234/AB.c.</othercit></nplcit></us-citation></us-references-cited><assignees><assignee><addressbook><orgname>Org</orgname><address><city>C</city></address></addressbook></assignee><assignee><orgname>Flat</orgname></assignee></assignees>{extra}</us-bibliographic-data-grant></us-patent-grant>
"""


def uspto(folder):
    os.makedirs(os.path.join(folder, "2023"), exist_ok=True)
    inventors = "<parties><inventors><inventor sequence='1'><addressbook><last-name>I</last-name></addressbook></inventor></inventors></parties>"
    for name, text in (("a.zip", patent(1) + patent(2, inventors)), ("b.zip", patent(3))):
        with zipfile.ZipFile(os.path.join(folder, "2023", name), "w") as z:
            z.writestr(name.replace("zip", "xml"), text)
    return str(folder)


def organisation(n, name, parent=None, **more):
    relations = [{"type": "Parent", "id": f"https://ror.org/{parent}"}] if parent else []
    return {"id": f"https://ror.org/{n}", "name": name, "status": "active", "established": 1900, "addresses": [{"city": "Town", "lat": 1.5, "lng": 2.5}], "country": {"country_code": "AV"}, "external_ids": {"GRID": {"all": "grid.1"}, "ISNI": {"all": ["i1", "i2"]}}, "types": ["Education"], "aliases": [], "acronyms": ["AC" + n], "links": [], "relationships": relations} | more


def ror(path):
    data = [organisation("o1", "Ministry of Science"), organisation("o2", "Alpha Institute", "o1"), organisation("o3", "Alpha Institute Annex", "o2"), organisation("o4", "Gone", status="withdrawn")]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("v1-ror-data.json", json.dumps(data))
    return str(path)
