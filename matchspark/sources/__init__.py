"""Sources and sinks: match logs on shared storage and the tables made from them."""
