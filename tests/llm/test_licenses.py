from ledgerloom.llm import licenses

MIT = """Copyright (c) 2020 Someone. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE."""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted:
1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice.
Neither the name of X may be used."""


def test_texts_and_edges(spark):
    rows = [
        (1, None, ""), (2, "", ""), (3, "no words of that kind here", ""),
        (4, "Foo bar.\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0.", "MIT,Apache-2.0"),
        (5, "This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        (6, "Licensed under CC BY-NC 4.0. All rights reserved.", "CC-BY-NC-4.0,LicenseRef-all-rights-reserved"),
        (7, MIT, "LicenseRef-all-rights-reserved,MIT"),
        (8, GPL, "GPL-3.0"),
        (9, "it is RELEASED\nunder the mit license", "MIT"),
        (10, "licensed by nobody, with permission", ""),
        (11, "x " * 50_000 + ". Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Apache-2.0"),
        (12, "Licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        (13, BSD.replace("1. ", "").replace("2. ", ""), "BSD-3-Clause"),
        (None, "All rights reserved.", "LicenseRef-all-rights-reserved"),
    ]
    rows.append(rows[3])
    df = spark.createDataFrame([(a, b, 1) for a, b, _ in rows], "doc_id long, text string, licenses int")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert {i: r["licenses"] for i, r in got.items()} == {i: w for i, _, w in rows}
    assert got[1]["n_sentences"] == 1 and got[4]["sentence_ids"] == "mit,apache2"
    assert licenses.scan(df).count() == len(rows) and licenses.scan(df.limit(0)).count() == 0
