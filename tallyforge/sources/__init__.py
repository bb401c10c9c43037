"""Tables in, tables out: schemas, dimensions, nested documents, manifests."""
