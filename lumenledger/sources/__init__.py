"""Where tables come from: declared schemas, the adapter from test tables, image and upload files."""
