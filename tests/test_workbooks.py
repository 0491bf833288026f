import zipfile
from datetime import date

from reconlake.sources.sheets import sheet_rows, workbook_bytes, workbook_rows
from reconlake.sources.workbooks import read_workbooks, workbook_files

D = date(2026, 4, 3)


def head(n, **cells):
    """n rows, some of them given as r3=[...]."""
    return [cells.get(f"r{i}", []) for i in range(n)]


def books():
    bci = ["Fecha de transacción", "Hora transacción", "Fecha contable", "Código de transacción", "Código Transferencia", "Tipo de transacción", "Numero serie", "Glosa detalle", "Ingreso (+)", "Egreso (-)", "Saldo contable", "Nombre", "RUT", "N° de Cuenta", "Tipo de Cuenta", "Banco"]
    row = lambda *x: list(x) + [None] * (16 - len(x))
    yield "bci.xlsx", {"Hoja 1": [[None, "ME BCI"], [], bci, row(D, "10:20", D, "1", "T77", "TEF", None, "Pago uno", 1500, None, 9000, "Ana Soto", "12.345.678-k", "00-123", "CC", "Banco X"), row(D, None, None, None, None, None, None, "sin monto"), row(D, "9:05", None, None, None, None, None, "Giro", None, "$700", 8300)]}
    info = dict(r3=["Empresa:", "ME SPA"], r4=["RUT empresa:", "77.333.096-4"], r6=["Cuenta Corriente N°: 0-000-9580058-0"])
    yield "move.xlsx", {"Otra": [["x"]], "Movimientos CtaCte": [*head(11, r0=["Consulta de movimientos de Cuentas Corrientes"], **info, r10=[None, None, None, None, "Fecha desde: 01/04/2026", "Fecha hasta: 30/04/2026"]), ["MONTO", "DESCRIPCIÓN", "FECHA", "SALDO", "N° DOCUMENTO", "SUCURSAL", "CARGO/ABONO"], ["1.000", "0085668013 Transf. ROHDIS TABILO", "03/04/2026", 50, "000000000", "Of. Centro", "C"], [-20, "Transf.Internet a 76.611.709-0", D, 51, "00077", None, "A"], ["x", "roto", D, 1, 1, 1, "A"]]}
    flagged = ["MONTO", "DESCRIPCIÓN", None, "FECHA", "N° DOCUMENTO", "SUCURSAL", None, "CARGO/ABONO"]
    line = lambda a, memo, d, doc, f: [a, memo, None, d, doc, "Suc", None, f]
    period = [None, None, "Fecha desde: 01/03/2026", "Fecha hasta: 31/03/2026"]
    balances = dict(r9=["SALDO INICIAL", "CARGOS", "ABONOS", "SALDO FINAL"], r10=[1, 2, 3, "123.456"])
    yield "hist.xlsx", {"Cartola Historica CtaCte": [*head(15, **info, r7=["Número cartola: 24", *period], **balances), flagged, line(500, "Abono a", D, "12", "A"), line(600, "Cargo b", D, "13", "C"), ["Resumen comisiones"], ["MONTO", "DESCRIPCIÓN"], line(700, "tarde", date(2026, 4, 2), "14", "A"), ["algo"], line(5, "sin fecha", None, "1", "A"), ["Saldos diarios"], line(900, "fuera", D, "15", "A")]}
    yield "prov.xlsx", {"CartolaProvisoria": [*head(12, r0=["Cartola provisoria Cta. Cte."], r6=["Cuenta 0-000-9405034-0"], r7=period, **balances), flagged, line(50, "Uno", D, "12", "C")]}
    two = ["Fecha", "Detalle", "Nº Documento", "Cargos", "Depositos", "Saldo"]
    yield "int_h.xlsx", {"Cartola Historica": [*head(16, r0=["Cartola Historica"], r7=["Nº de Cuenta", None, "000-12-34"], r9=["Periodo", None, "Abril 2026"]), two, ["03/04/2026", "TRANSF. PARA Vector capital 77333096-4", "0012", 700, None, 1], ["04/04/2026", "dos", "0", 10, 30, 2], ["05/04/2026", "nada", "0", 0, 0, 2]]}
    for name, sheet in (("int_p", "Movimientos entre Fechas"), ("int_m", "Movimientos del Mes")):
        yield f"{name}.xlsx", {sheet: [*head(16, r0=[sheet], r7=["Nº de Cuenta", None, "5-6"], r9=["Desde", None, "01/04/2026"], r10=["Hasta", None, D]), two, [D, "x", "", None, 40, 7]]}
    yield "chile.xlsx", {"Sheet1": [["ME SPA      (77333096-4) cta:000051541406"], ["Fecha", "Detalle Movimiento", "Cheque o Cargo", "Deposito o Abono", "Saldo", "Docto. Nro.", "Trn", "Caja", "Sucursal"], ["03/04/26", "Traspaso A: Sonia Munoz", "0000000000000000300000", "0", "+5", "00", 1, 2, "Centro"]]}
    yield "cartola.xlsx", {"Hoja1": [*head(7), [None, "Sr(a).:", None, "Alexis"], [None, "Nombre Empresa:", None, "ME SPA"], [None, "Rut:", None, "77.333.096-4"], [None, "Cuenta N°:", None, "00-005-15414-06"], [], ["Fecha", "Descripcion", "Canal o Sucursal", "Nro. Docto.", "Cargos (CLP)", "Abonos (CLP)", "Saldo (CLP)"], [D, "Traspaso De: Me Spa", "Internet", "0045", None, 900, 1000]]}
    yield "none.xlsx", {"Hoja1": [["nothing", "here"]]}


def test_rows_of_a_workbook(tmp_path):
    made = workbook_bytes({"A & B": [["text <x>", 1, 1.5, None, D], [], [None, "  last "]], "two": [["y"]]})
    assert list(sheet_rows(made)) == [(0, "A & B", 0, ["text <x>", "1", "1.5", None, "2026-04-03"]), (0, "A & B", 2, [None, "  last "]), (1, "two", 0, ["y"])]


def test_shared_strings_times_and_rows_without_places(spark, tmp_path):
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="k"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="k" Target="/xl/worksheets/one.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{ns}"><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy hh:mm"/><numFmt numFmtId="171" formatCode="#,##0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="21"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row r="5"><c r="C5" s="1"><v>46115.5</v></c><c r="AA5" s="2"><v>12</v></c><c s="3"><v>0.25</v></c><c t="b"><v>1</v></c><c t="str"><v>f</v></c></row></sheetData></worksheet>')
    (tmp_path / "broken.xlsx").write_bytes(b"PK\x03\x04 no")
    got = {(r.row_no, r.problem is None): r.cells for r in workbook_rows(workbook_files(spark, str(tmp_path))).collect()}
    assert got[0, True] == ["plain", "rich"] and got[4, True] == [None, None, "2026-04-03 12:00:00", *[None] * 23, "12", "06:00:00", "1", "f"] and (None, False) in got


def test_nine_layouts(spark, tmp_path):
    for name, sheets in books():
        (tmp_path / name).write_bytes(workbook_bytes(sheets))
    (tmp_path / "zz.xlsx").write_bytes(b"not a workbook")
    found = read_workbooks(workbook_files(spark, str(tmp_path)))
    short = lambda r: r.file.rsplit("/", 1)[-1].removesuffix(".xlsx")
    got = sorted((short(r), r.line_no, str(r.post_date), r.amount, r.memo, r.reference, r.balance_after, r.counterparty, r.counterparty_tax_id, r.branch, r.kind) for r in found.movements.collect())
    assert got == [
        ("bci", 3, "2026-04-03", 1500, "Pago uno", "T77", 9000, "Ana Soto", "12345678-K", None, "TEF"),
        ("bci", 5, "2026-04-03", -700, "Giro", None, 8300, None, None, None, None),
        ("cartola", 13, "2026-04-03", 900, "Traspaso De: Me Spa", "45", 1000, "Me Spa", None, "Internet", "ABONO"),
        ("chile", 2, "2026-04-03", -300000, "Traspaso A: Sonia Munoz", None, 5, "Sonia Munoz", None, "Centro", "CARGO"),
        ("hist", 16, "2026-04-03", 500, "Abono a", "12", None, "Abono a", None, "Suc", "ABONO"),
        ("hist", 17, "2026-04-03", -600, "Cargo b", "13", 123456, "Cargo b", None, "Suc", "CARGO"),
        ("hist", 20, "2026-04-02", 700, "tarde", "14", None, "tarde", None, "Suc", "ABONO"),
        ("int_h", 17, "2026-04-03", -700, "TRANSF. PARA Vector capital 77333096-4", "12", 1, "Vector capital", "77333096-4", None, None),
        ("int_h", 18, "2026-04-04", 30, "dos", None, 2, "dos", None, None, None),
        ("int_m", 17, "2026-04-03", 40, "x", None, 7, None, None, None, None),
        ("int_p", 17, "2026-04-03", 40, "x", None, 7, None, None, None, None),
        ("move", 12, "2026-04-03", -1000, "0085668013 Transf. ROHDIS TABILO", None, 50, "ROHDIS TABILO", None, "Of. Centro", "CARGO"),
        ("move", 13, "2026-04-03", 20, "Transf.Internet a 76.611.709-0", "77", 51, "Internet a 76.611.709-0", "76611709-0", None, "ABONO"),
        ("prov", 13, "2026-04-03", -50, "Uno", "12", 123456, "Uno", None, "Suc", "CARGO"),
    ]
    told = sorted((short(r), r.layout, r.account_number, r.holder, r.holder_tax_id, str(r.period_from), str(r.period_to)) for r in found.statements.collect())
    assert told == [
        ("bci", "BCI_DETALLADO", None, None, None, "2026-04-03", "2026-04-03"),
        ("cartola", "CHILE_CARTOLA", "51541406", "ME SPA", "77333096-4", "2026-04-03", "2026-04-03"),
        ("chile", "CHILE_MOVIMIENTOS", "51541406", "ME SPA", "77333096-4", "2026-04-03", "2026-04-03"),
        ("hist", "SANTANDER_HISTORICA", "95800580", "ME SPA", "77333096-4", "2026-03-01", "2026-03-31"),
        ("int_h", "INTERNACIONAL_HISTORICA", "1234", None, None, "2026-04-01", "2026-04-30"),
        ("int_m", "INTERNACIONAL_MENSUAL", "56", None, None, "2026-04-01", "2026-04-03"),
        ("int_p", "INTERNACIONAL_PROVISORIA", "56", None, None, "2026-04-01", "2026-04-03"),
        ("move", "SANTANDER_MOVIMIENTO", "95800580", "ME SPA", "77333096-4", "2026-04-01", "2026-04-30"),
        ("prov", "SANTANDER_PROVISORIA", "94050340", None, None, "2026-03-01", "2026-03-31"),
    ]
    assert sorted((short(r), r.line_no, r.reason) for r in found.errors.collect()) == [("bci", 4, "no amount"), ("hist", 22, "no date"), ("int_h", 19, "no amount"), ("move", 14, "no amount")]
    assert sorted((short(r), r.problem is not None) for r in found.unknown.collect()) == [("none", False), ("zz", True)]
    done = {short(r): str(r.done_at) for r in found.movements.where("done_at IS NOT NULL").collect() if r.amount > 0}
    assert done == {"bci": "2026-04-03 10:20:00"}
