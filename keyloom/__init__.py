"""DataFrame operators for keyed, labelled text: records that carry a text, a class label and a key."""
