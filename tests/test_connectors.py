"""Connectors over small files written here."""

import io
import json
import struct
import zipfile

import pytest

from ledgerline.sources import tables  # noqa: I001


def sheet(rows, name):
    """A minimal workbook with inline texts and numbers."""
    def cell(r, c, v):
        at = f"{chr(65 + c)}{r}"
        return "" if v is None else f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{at}"><v>{v}</v></c>'

    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def record(number, body):
    """A record of a binary workbook: its number in one or two bytes, its size in groups of seven bits."""
    head = bytes([number]) if number < 0x80 else bytes([number & 0xFF, number >> 8])
    size, n = b"", len(body)
    while True:
        size += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return head + size + body


def wide(text):
    return struct.pack("<I", len(text)) + text.encode("utf-16-le")


def binary(sheets):
    """A binary workbook: numbers as doubles, small numbers or hundredths, texts shared or in place, blanks, rows left out (None)."""
    shared, parts = [], {}
    for k, (name, rows) in enumerate(sheets.items(), 1):
        body = record(129, b"") + record(145, b"")
        for r, row in enumerate(rows):
            if row is None:
                continue
            body += record(0, struct.pack("<I", r) + bytes(13))
            for c, v in enumerate(row):
                cell = struct.pack("<I", c) + bytes(4)
                if v is None:
                    body += record(1, cell) if c % 2 else b""
                elif isinstance(v, bool):
                    body += record(4, cell + bytes([v]))
                elif isinstance(v, int):
                    body += record(2, cell + struct.pack("<I", (v << 2 | 2) & 0xFFFFFFFF))
                elif isinstance(v, float):
                    body += record(2, cell + struct.pack("<I", (round(v * 100) << 2 | 3) & 0xFFFFFFFF)) if v * 100 == int(v * 100) and abs(v) < 1e6 else record(5 if c % 2 else 9, cell + struct.pack("<d", v))
                elif c % 3 == 0:
                    body += record(6, cell + wide(v))
                else:
                    shared.append(v)
                    body += record(7, cell + struct.pack("<I", len(shared) - 1))
        parts[f"xl/worksheets/sheet{k}.bin"] = body + record(146, b"") + record(130, b"")
    book = record(131, b"") + b"".join(record(156, struct.pack("<II", 0, k) + wide(f"rId{k}") + wide(name)) for k, name in enumerate(sheets, 1)) + record(132, b"")
    links = "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.bin"/>' for k in range(1, len(sheets) + 1))
    strings = record(159, struct.pack("<II", len(shared), len(shared))) + b"".join(record(19, b"\0" + wide(x)) for x in shared) + record(160, b"")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.bin", book)
        z.writestr("xl/_rels/workbook.bin.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/sharedStrings.bin", strings)
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


UNITS = [None, ["title"], None, None, None, None]


def archived(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def lines(*rows):
    return "\n".join(json.dumps(r) for r in rows)


CASES = {
    "facilities": ("f.csv", "FACILITY_ID,YEAR,FACILITY_NAME\n1,2020,B\n1,2020,A\n2,x,C\n", ("facility_id", "year", "facility_name"), [(1, 2020, "A"), (2, None, "C")]),
    "facility_emissions": ("e.csv", "facility_id,year,sector_id,subsector_id,gas_id,co2e_emission\n1,2020,3,1,1,10\n1,2020,3,1,1,10\n1,2020,3,1,8,4\n1,2020,10,1,1,7\n2,2020,3,1,8,9\n3,2020,10,1,1,2\n3,2020,3,1,8,5\n", ("facility_id", "scope1_t", "biogenic_t", "supplied_t"), [(1, 10.0, 4.0, 7.0), (3, 0.0, 0.0, 2.0)]),
    "unit_emissions": ("u.json", lines({"facilityId": 1, "year": 2020, "facilityName": "A", "unitId": "x", "co2Mass": 1.0}, {"facilityId": 1, "year": 2020, "facilityName": "A", "unitId": "y", "co2Mass": 1.0}), ("facilityId", "co2_t", "n_units"), [(1, 1.81436948, 2)]),
    "unit_facilities": ("u.json", lines({"facilityId": 1, "year": 2020, "facilityName": "B"}, {"facilityId": 1, "year": 2020, "facilityName": "A"}), ("facilityId", "facilityName"), [(1, "A")]),
    "power_plants": ("egrid2022.xlsx", sheet([["title"], ["ORISPL", "PNAME", "PLNGENAN", "PLCO2AN"], [7, "North", 100.5, 2], [8, "South", None, 3]], "plnt22"), ("oris_code", "plant_name", "net_generation_mwh", "co2_t", "year"), [(7, "North", 100.5, 2.0, 2022)]),
    "plant_fuel": ("p.json", lines({"plantCode": 1, "period": 2020, "plantName": "N", "fuel2002": "all", "primeMover": "ALL", "generation": 2.0, "total-consumption-btu": "5"}, {"plantCode": 1, "period": 2020, "fuel2002": "COL", "primeMover": "ALL", "generation": 2.0}), ("plantCode", "plantName", "state", "year", "generation_mwh", "consumption_mmbtu"), [(1, "N", None, 2020, 2.0, 5.0)]),
    "plant_crosswalk": ("x.csv", "EPA_FACILITY_ID,EIA_PLANT_ID\n1,2\n1,2\n3,\n", ("epa_id", "eia_id"), [(1, 2)]),
    "releases": ("2023_us.csv", "1. YEAR,12. TOTAL RELEASES,13. UNIT OF MEASURE,14. CARCINOGEN,15. ELEMENTAL METAL/METAL\n2022,453.592,Grams,NO,a\n2022,5,Pounds,YES,b\n", ("year", "total_releases", "unit_of_measure", "carcinogen", "elemental_metal_metal"), [(2023, 453.592, "Grams", "NO", "a"), (2023, 5.0, "Pounds", "YES", "b")]),
    "injuries": ("ITA_2025.zip", archived({"a.csv": "Company_Name,total_dafw_cases,total_djtr_cases,total_hours_worked,year_filing_for\nX,1,1,200000,2023\n", "b.CSV": "company_name,total_dafw_cases,total_djtr_cases,total_hours_worked,year_filing_for\nY,1,1,0,2024\nZ,2,,200000,2024\n", "no.txt": "z"}), ("company_name", "year", "dart_rate"), [("X", 2025, 2.0), ("Y", 2025, None), ("Z", 2025, 2.0)]),
    "enforcement": ("e.zip", archived({"f.csv": "REGISTRY_ID,FAC_TOTAL_PENALTIES,FAC_3YR_COMPLIANCE_HISTORY\n11,-,VS__V_______V\n"}), ("registry_id", "fac_total_penalties", "bad_quarters"), [(11, None, 3)]),
    "wage_cases": ("w.zip", archived({"w.csv": "case_id,cmp_assd,findings_end_date,FLSA_CL_MINOR_CNT,flsa_repeat_violator\n1,5,2023-01-02,3,R\n2,5,2019-01-02\n3,5,odd\n"}), ("case_id", "cmp_assd", "flsa_cl_minor_cnt", "flsa_repeat_violator"), [("1", 5.0, 3.0, "R")]),
    "revenue": ("v.json", lines({"tag": "SalesRevenueNet", "ccp": "CY2020", "data": [{"cik": 1, "entityName": "A", "val": 5e6, "end": "2020-12-31"}]}, {"tag": "Revenues", "ccp": "CY2020", "data": [{"cik": 1, "entityName": "A", "val": 9e6, "end": "2020-12-31"}, {"cik": 2, "entityName": "B", "val": 3e6, "end": "2020-12-31"}]}, {"tag": "RevenueFromContractWithCustomerExcludingAssessedTax", "ccp": "CY2020", "data": [{"cik": 1, "entityName": "A", "val": 6e6, "end": "2020-12-31"}]}, {"tag": "OperatingRevenues", "ccp": "CY2020", "data": [{"cik": 3, "entityName": "C", "val": 1e6, "end": "2020-12-31"}]}), ("cik", "year", "revenue_musd", "concept"), [(1, 2020, 6.0, "RevenueFromContractWithCustomerExcludingAssessedTax"), (2, 2020, 3.0, "Revenues")]),
    "targets": ("t.xlsx", sheet([["Company Name", "Near term - status", "near_term_status", "near_term_target_year", "net_zero_year", "net_zero_status", "near_term_target_classification"], ["A", "", "Targets Set", "FY2030", "by 2050", "Removed", "1.5C"], ["B", "", "Commitment removed", None, None, None, None]], "Targets"), ("company_name", "near_term_class", "near_term_year", "net_zero_year", "commitment_removed", "has_validated_target"), [("A", "1.5C", 2030, 2050, True, True), ("B", None, None, None, True, False)]),
    "ratings": ("s.csv", "ticker,company,sector,esgScore.tot,esgRating,Market.Cap\nBRK.B,Berk,F,12.5,Low,7\nX,Y,Z,,,\n", ("ticker", "esg_risk_total", "esg_rating_label", "market_cap_usd", "as_of"), [("BRK-B", 12.5, "Low", 7.0, None)]),
    "hard_variables": ("h.csv", "ticker,a\n BF.B , 1 \n", ("ticker", "a"), [("BF-B", "1")]),
    "benchmark_scores": ("b.json", json.dumps({"companies": [{"wba": {"name": "A"}, "match_method": "m", "tickers": ["X.A", "Y"], "assessment": {"tpq": 3.0, "source": {"url": "u", "retrieved_at": "d"}}}, {"wba": {"name": "B"}, "tickers": ["Z"]}]}), ("ticker", "wba_name", "match_method", "tpq", "profile_url", "retrieved_at"), [("X-A", "A", "m", 3.0, "u", "d"), ("Y", "A", "m", 3.0, "u", "d")]),
    "yearly_emissions": ("y.xlsx", sheet([["t"], [""], ["x"], ["Facility Id", "Facility Name", "2020 Total reported direct emissions", "2021 Total reported direct emissions"], [5, "N", 10, 0]], "Direct Emitters"), ("facility_id", "year", "direct_t"), [(5, 2020, 10.0)]),
    "parent_links": ("l.csv", "GHGRP FACILITY ID,PARENT COMPANY NAME,parent co. percent ownership,REPORTING YEAR\n1, A ,150,2020\n1,B,,2020\n", ("parent_name_raw", "parent_share_pct"), [("A", 100.0), ("B", 100.0)]),
    "parent_links_binary": ("p.xlsb", binary({"2022": [["GHGRP Facility ID", " Parent Company Name", "Parent Co. Percent Ownership"], [1001, " Äon AG ", 150], [1002, "B", None], ["x", "C", 5], [1003, None, 5]], "notes": [["a"]], "2023": [["GHGRP FACILITY ID", "PARENT COMPANY NAME", "PARENT CO. PERCENT OWNERSHIP"], [1001, "B", 33.25]], "2024": [["other"], [1]]}), ("facility_id", "parent_name_raw", "parent_share_pct", "reporting_year"), [(1001, "Äon AG", 100.0, 2022), (1002, "B", 100.0, 2022), (1001, "B", 33.25, 2023)]),
    "facility_fuel": ("u.xlsb", binary({"UNIT_DATA": [["z"]], "Fuel_Data": [*UNITS, [f"h{k}" for k in range(14)], [5, *[None] * 5, 2022, None, None, None, "Coal", "Lignite", True, 12.5], [6, *[None] * 5, 2022, None, None, None, "Gas", None, None, 0], [7.0, *[None] * 5, "2021", None, None, None, "Oil", "x", None, 123456789.125]]}), ("facility_id", "reporting_year", "fuel_general", "fuel_specific", "co2_tonnes"), [(5, 2022, "Coal", "Lignite", 12.5), (7, 2021, "Oil", "x", 123456789.125)]),
    "facility_units": ("u.xlsb", binary({"UNIT_DATA": [*UNITS, [f"h{k}" for k in range(16)], [5, *[None] * 5, 2022, *[None] * 4, "Tier4", None, 3], [5, *[None] * 5, 2022, *[None] * 4, None, None, 4.5], [5, *[None] * 5, None, *[None] * 4, "P75", None, 4.5]]}), ("facility_id", "method", "co2_tonnes", "is_cems"), [(5, "Tier4", 3.0, True), (5, None, 4.5, False)]),
    "latest_revenue": ("q.csv", "ticker,revenue_ttm_busd\nA.B,1.5\n", ("ticker", "revenue_usd"), [("A-B", 1.5e9)]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_connector(spark, tmp_path, name):
    file, content, columns, want = CASES[name]
    path = tmp_path / file
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    got = [tuple(r[c] for c in columns) for r in tables.get(name)(spark, str(path)).collect()]
    key = lambda r: [str(x) for x in r]
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a == pytest.approx(b)


def test_plain_releases_and_odd_bytes(spark, tmp_path):
    """A release that is a CSV file, not an archive, and bytes that aren't UTF-8."""
    (tmp_path / "ITA_2025_v2.csv").write_bytes(b"Company_Name,total_dafw_cases,total_djtr_cases,total_hours_worked,year_filing_for\nCaf\xe9,1,1,200000,2025\n")
    assert [(r["company_name"], r["year"], r["dart_rate"]) for r in tables.get("injuries")(spark, str(tmp_path / "ITA_2025_v2.csv")).collect()] == [("Caf\ufffd", 2025, 2.0)]
    (tmp_path / "w.zip").write_bytes(archived({"w.csv": b"case_id,trade_nm,findings_end_date\n1,Caf\xe9,2023-01-02\n"}))
    assert [r["trade_nm"] for r in tables.get("wage_cases")(spark, str(tmp_path / "w.zip")).collect()] == ["Caf\ufffd"]
    (tmp_path / "e.zip").write_bytes(archived({"f.csv": "REGISTRY_ID,CAA_QTRS_IN_NC,FAC_DATE_LAST_PENALTY\n11,3,01/02/2024\n"}))
    assert [(r["caa_qtrs_in_nc"], r["fac_date_last_penalty"], r["rcra_qtrs_in_nc"]) for r in tables.get("enforcement")(spark, str(tmp_path / "e.zip")).collect()] == [("3", "01/02/2024", None)]


def test_other_connectors(spark, tmp_path):
    spark.sql("select 1L plant_id, timestamp '2020-05-01' report_date, 3.0D net_generation_mwh union all select 1L, timestamp '2020-06-01', 2.0D union all select 2L, timestamp '2020-06-01', -1.0D").write.parquet(str(tmp_path / "g"))
    assert [tuple(r) for r in tables.get("plant_generation")(spark, str(tmp_path / "g")).collect()] == [(1, 2020, 5.0)]
    (tmp_path / "p.html").write_text('<html><script type="x" id="data">\n{"a": [1]}\n</script></html>')
    got = tables.get("embedded_data")(spark, str(tmp_path / "p.html")).selectExpr("variant_get(data, '$.a[0]', 'int') a").collect()
    assert [r["a"] for r in got] == [1]
    assert set(CASES) | {"plant_generation", "embedded_data", "issuers", "company_facts"} == set(tables.available())
