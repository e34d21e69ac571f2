"""The catalogue of stylesheet crosswalks and the commands that run them.

The sheets themselves are not part of this package: put those you use beside your data.  MODS,
Dublin Core, schema.org and BIBFRAME are built in as record functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Alias, sheet, source and target format, description.
CROSSWALKS = [
    ("MARC=>MODS", "xslt/marcxml-to-mods.xsl", "MARC", "MODS", "MARCXML (slim) to MODS 3.7, implemented from the Library of Congress MARC to MODS mapping specification."),
    ("MODS=>MARC", "xslt/mods-to-marcxml.xsl", "MODS", "MARC", "MODS 3.x back to MARCXML (slim) with a synthesized leader and 008, covering the core of the forward crosswalk."),
    ("MARC=>OAI_DC", "xslt/marcxml-to-oai_dc.xsl", "MARC", "OAI_DC", "MARCXML (slim) to simple Dublin Core in the OAI-PMH oai_dc container; collections get a neutral dcRecords wrapper."),
    ("OAI_DC=>MARC", "xslt/oai_dc-to-marcxml.xsl", "OAI_DC", "MARC", "Simple Dublin Core (oai_dc, OAI-PMH responses, dcRecords) to minimally valid MARCXML with leader and 008 constructed."),
    ("MARC=>DCTERMS", "xslt/marcxml-to-dcterms.xsl", "MARC", "DCTERMS", "MARCXML (slim) to qualified Dublin Core in the DCMI Metadata Terms namespace, as plain qdcRecord elements without RDF."),
    ("MARC=>RDFDC", "xslt/marcxml-to-rdfdc.xsl", "MARC", "RDF-DC", "MARCXML (slim) to RDF/XML built on DCMI Metadata Terms; one rdf:Description per record, first 856$u becomes rdf:about."),
    ("MARC=>EAD3", "xslt/marcxml-to-ead.xsl", "MARC", "EAD3", "MARCXML (slim) to a collection-level EAD3 finding-aid skeleton: control, archdesc did, scopecontent and controlaccess."),
    ("MARC=>HTML", "xslt/marcxml-to-html.xsl", "MARC", "HTML", "A human-readable rendering of MARCXML: one card per record, 245 as heading, leader and fields as a tag/indicator/subfield table."),
    ("MARC=>SCHEMA.ORG", "xslt/marcxml-to-schemaorg.xsl", "MARC", "JSON-LD", "MARCXML (slim) to schema.org JSON-LD, one object per record as NDJSON, mirroring the marc_jsonld SQL macro key for key."),
    ("MARC=>RIS", "xslt/marcxml-to-ris.xsl", "MARC", "RIS", "MARCXML (slim) to RIS citation records: reference type from leader/06-07, tagged lines, ER terminator per record."),
    ("MARC=>UNIMARC", "xslt/marc21-to-unimarc.xsl", "MARC", "UNIMARC", "MARC 21 Bibliographic to UNIMARC Bibliographic at field level, written from the IFLA UNIMARC Manual; slim XML container both sides."),
    ("MARC=>UNIMARC-SKELETON", "xslt/marc21-to-unimarc-skeleton.xsl", "MARC", "UNIMARC", "MARC 21 to UNIMARC-shaped MARCXML, a documented subset: record label, 001, 100, 101, 200, 210, 215, 606, 700/701."),
    ("UNIMARC=>MARC", "xslt/unimarc-to-marc21.xsl", "UNIMARC", "MARC", "UNIMARC Bibliographic to MARC 21 Bibliographic at field level, the inverse of the IFLA-based forward crosswalk."),
    ("RUSMARC=>MARC", "xslt/rusmarc-to-marc21.xsl", "RUSMARC", "MARC", "RUSMARC Bibliographic to MARC 21, a delta over the UNIMARC crosswalk: 686 BBK to 084 with $2 rubbk, 802 to 022 $2, the 801 source conventions, the coded 100 $a positions and the 9XX national block."),
    ("MARC=>RUSMARC", "xslt/marc21-to-rusmarc.xsl", "MARC", "RUSMARC", "MARC 21 Bibliographic to RUSMARC, the inverse delta: 084 $2 rubbk to 686, 022 $2 to 802, 801 with the Russian country, agency, date and cataloguing-rules subfields, 9XX carried through."),
    ("KORMARC=>MARC", "xslt/kormarc-to-marc21.xsl", "KORMARC", "MARC", "KORMARC (KS X 6006) to MARC 21: 056 KDC to 084 $2 kdc, 049 holdings and the 090/052 call numbers to 852, 940 to 246, 950 to 037 $c; shared fields copied in tag order."),
    ("MARC=>KORMARC", "xslt/marc21-to-kormarc.xsl", "MARC", "KORMARC", "MARC 21 to KORMARC (KS X 6006), the inverse: 084 $2 kdc to 056, 852 to 049 and 090, 037 $c to 950; everything else copied in tag order."),
    ("INTERMARC=>MARC", "xslt/intermarc-to-marc21.xsl", "INTERMARC", "MARC", "INTERMARC (BnF) to MARC 21, an honest subset: headings with the numeric function codes as relator codes, 145 to 240, 245 and 260 by shape-tolerant rules, 280 to 300, the 3XX notes, and the RAMEAU 6XX block."),
    ("MARC=>INTERMARC", "xslt/marc21-to-intermarc.xsl", "MARC", "INTERMARC", "MARC 21 to INTERMARC (BnF), the inverse of the same subset; no coded data is generated."),
    ("JAPANMARC=>MARC", "xslt/japanmarc-normalize.xsl", "JAPANMARC", "MARC", "JAPAN/MARC MARC21 reading and parallel-script conventions expressed as standard 880 and $6 linkage: pairs, occurrence numbers, script identification codes and indicators repaired; content untouched."),
    ("IBERMARC=>MARC", "xslt/ibermarc-to-marc21.xsl", "IBERMARC", "MARC", "IBERMARC (Spain, retired) to MARC 21: 017 to 016, the 59X local block kept, leader lengths zeroed and UTF-8 declared, everything else copied in tag order."),
    ("MAB2=>MARC", "xslt/mab2-to-marc21.xsl", "MAB2", "MARC", "MAB2 (Germany and Austria, retired) to MARC 21: the bibliographic core from the published field directory; expects slim-shaped input and does not interpret the MAB2 record label."),
    ("MARC=>ONIX3", "xslt/marcxml-to-onix3.xsl", "MARC", "ONIX3", "MARCXML (slim) to ONIX for Books 3.x Product records with reference tag names; an honest subset of a full trade Product message."),
    ("MARC=>EDM", "xslt/marcxml-to-edm.xsl", "MARC", "EDM", "MARCXML (slim) to Europeana Data Model RDF/XML: edm:ProvidedCHO, ore:Aggregation and edm:WebResource per record."),
    ("MARC=>MADS", "xslt/marcxml-to-mads.xsl", "MARC-AUTHORITY", "MADS", "MARC 21 Authority records to MADS 2.x: 1XX authority, 4XX variants, 5XX related, 667/670 notes, 010/001 identifiers."),
    ("MARC=>BIBFRAME2", "xslt/marcxml-to-bibframe2.xsl", "MARC", "BIBFRAME2", "MARCXML (slim) to BIBFRAME 2.x RDF/XML: sibling bf:Work, bf:Instance and bf:Item resources with the documented subset of properties."),
    ("BIBFRAME2=>MARC", "xslt/bibframe2-to-marcxml.xsl", "BIBFRAME2", "MARC", "BIBFRAME 2.x RDF/XML back to MARCXML (slim); inverts exactly the resource shapes the forward crosswalk emits."),
]


def crosswalks(spark: SparkSession) -> DataFrame:
    """(alias, path, source_format, target_format, description)."""
    return spark.createDataFrame(CROSSWALKS, "alias string, path string, source_format string, target_format string, description string")


def sheet_file(alias_or_path: str | None) -> str | None:
    """File name of a sheet by its alias, in any case, or its path."""
    for alias, path, *_ in CROSSWALKS:
        if alias_or_path is not None and (alias.upper() == alias_or_path.upper() or path == alias_or_path):
            return path.rsplit("/", 1)[-1]
    return None


def shell_argument(value: str) -> str:
    return "'" + value.replace("'", "'\\''") + "'"


def command(crosswalk: str, input_path: str, output_path: str) -> str | None:
    """The xsltproc command line, None for an unknown crosswalk."""
    sheet = sheet_file(crosswalk)
    return None if sheet is None else " ".join(["xsltproc", "--output", *map(shell_argument, (output_path, sheet, input_path))])
