"""What the test modules of the llm operators share."""

import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
