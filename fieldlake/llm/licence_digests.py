"""Canonical digests (see licences) of whole licence texts as published, and of the same up to the end of their terms."""

#: (identifier, SHA-256 of the canonical text); from /usr/share/common-licenses; GPL-3.0 also as it is spread with sources.
DIGESTS = (
    ("Apache-2.0", "16df55bcc78fd42b907ae0cbafbdf3a490dbdfb298530e6461baedda6d415426"),
    ("Apache-2.0", "ad5cb4a9133f7b328244a1e5dec5b807680758c9054d9aa23c537d37035c5e4d"),
    ("Apache-2.0", "e47c26565f57f0d69b818dcb2ba49c6432329ebac35835ef90a9a64387461b8a"),
    ("CC0-1.0", "adf75bc38a3fbbdcbadda90b262623acbb176db40d4de0538e4bddaa4c7f8d2a"),
    ("GPL-2.0", "07ebd4578b4820b97e5191b3a98a59389575cfec92eb38a8393312afdf8d41e4"),
    ("GPL-2.0", "5ca608bb2eb79eb10b1a80b55bb0a99df497ce228143b9d233b5df274e85643a"),
    ("GPL-2.0", "f5fd437ddb5aa37b08e6703240178df2a26a44ed95a123f8fd06e6d74ab5ca1b"),
    ("GPL-3.0", "120d515babab807a18caa877f31d5f48e5aed13cc2d6700e64ecec7779409bd6"),
    ("GPL-3.0", "64532c029ba7063dcc4308d58acad893e9a02984ea2721e8ea29cfe7cb211ac6"),
    ("GPL-3.0", "cabccb86e314285bd22384eff6a86b75c37bea20224092b87b3ae4e63a2c437d"),
    ("GPL-3.0", "ecfe4cd454ee32a51ec94986a2efeb72f6233122aad571023e176317d1975778"),
    ("LGPL-2.1", "5ef8b7ba71d31fa31954beed6b9d500255758be9aaae1903502fe0f4c080e8d9"),
    ("LGPL-2.1", "dfb509c568fdca357b76a1c523438615ce8698edf63076cc8a224aac11a0199a"),
    ("LGPL-2.1", "ff0a54abc5f9cfefbee802398fd1e6974a2b6d7892c9094410ad655c56e8d867"),
    ("LGPL-3.0", "828c3944cde1fc14c68737c9be14d8d0f4f13ab980f8a72364a0e64f72965525"),
    ("MPL-2.0", "708209ded1169422ad8c0708b97d9446679d1cfabd60d9cbf877df831dc2cf61"),
)
